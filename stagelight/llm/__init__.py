"""Operators of a training-data pipeline: deduplication, tokens, language, toxicity, language models, media, licences, chat."""
