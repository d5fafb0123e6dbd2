"""The registered queries of the subpackage and, where SQL can say them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagelight.sources.scratch import scratch_dir

from . import chat, darts, decontamination, divergence, fim, langid, licenses, lines, media, ngrams, pieces, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = "list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_line_dedup", """
WITH l AS (SELECT doc_id, no - 1 AS no, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
u AS (SELECT doc_id, no, doc_id * 1000000 + no AS place, w, len(w) AS n, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= 5),
d AS (SELECT s, min(place) AS e, any_value(w) AS w, any_value(n) AS n FROM u GROUP BY s),
k AS (SELECT s, e, array_to_string(w[1 : i - 1], ' ') || '|' || array_to_string(w[i + 1 : n], ' ') AS g, true AS cut FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 10)
  UNION ALL SELECT s, e, array_to_string(w[1 : i - 1], ' ') || '|' || array_to_string(w[i : n], ' ') AS g, false AS cut FROM (SELECT *, unnest(range(1, n + 2)) AS i FROM d WHERE n >= 10)),
m AS (SELECT g, min(e) FILTER (cut) AS c, min(e) FILTER (NOT cut) AS p FROM k GROUP BY g HAVING count(DISTINCT s) > 1),
nr AS (SELECT s, min(least(c, CASE WHEN cut THEN p END)) AS f FROM k JOIN m USING (g) GROUP BY s, e HAVING min(least(c, CASE WHEN cut THEN p END)) < e),
x AS (SELECT u.doc_id, u.no, nr.s IS NOT NULL AS near FROM u JOIN d USING (s) LEFT JOIN nr ON nr.s = u.s WHERE nr.s IS NOT NULL OR u.place > d.e),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(x.no) AS n_dropped, coalesce(sum(x.near::INT), 0)::BIGINT AS n_near, string_agg(line, chr(10) ORDER BY l.no) FILTER (x.no IS NULL) AS text
  FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.no = l.no GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(n_near, 0)::BIGINT AS n_near
FROM documents d LEFT JOIN t USING (doc_id)
""")
def op1(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, counts=True)


#: Vocabulary of the piece operators; a file of a public tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_sentencepiece")
def op2(spark, folder):
    return pieces.encode(table(spark, folder, "documents"), PIECES)


@query("op3_language_id")
def op3(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.train(docs, PIECES))


@query("op4_toxicity")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op5_lm_scoring")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    return ngrams.score(docs, ngrams.train(docs))


@query("op6_media_columns")
def op6(spark, folder):
    return media.media_columns(table(spark, folder, "documents"))


@query("op7_license_scan")
def op7(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op8_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM b WHERE len(w) > 0),
wk AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM win),
dw AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM wk) WHERE len(w) >= n),
hit AS (SELECT k, item_id, dw.i AS i, dw.n AS n FROM dw JOIN wk ON wk.n = dw.n AND wk.g = array_to_string(dw.w[dw.i : dw.i + dw.n - 1], ' ')),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
""")
def op8(spark, folder):
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CONTROL_SQL = "[" + ", ".join(f"'{c}'" for c in chat.CONTROL) + "]"


@query("op9_chat_formatting", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
    + list_sum(list_transform({CONTROL_SQL}, lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(role) + {len(chat.BEGIN) + 1 + len(chat.END)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op9(spark, folder):
    rows = chat.turn_records(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    told = "</s>[INST] ok [/INST]"
    extra = chat.turn_records(spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string"))
    folder = f"{scratch_dir(spark)}/turns"
    chat.format_records(rows.unionByName(extra)).write.parquet(folder)
    return chat.read_back(spark.read.parquet(folder))


@query("op10_minhash_near_dedup")
def op10(spark, folder):
    return darts.near_groups(table(spark, folder, "documents"))


@query("op11_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM t GROUP BY ALL),
kt AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
kl AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kt GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(kl.n), 0) AS n_lang FROM d LEFT JOIN kl USING (lang) GROUP BY lang, source),
kc AS (SELECT c.lang, c.source, c.term, c.n, kt.n AS n_lang FROM c JOIN kt USING (lang, term)),
gn AS (SELECT g.*, coalesce((SELECT sum(kc.n) FROM kc WHERE kc.lang = g.lang AND kc.source = g.source), 0)::BIGINT AS n FROM g),
a AS (SELECT gn.lang, gn.source, kt.term, (1 + 1000000000::HUGEINT * (coalesce(kc.n, 0) + 5) // (gn.n + 5 * gn.v))::BIGINT AS p, coalesce(kc.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (kt.n + 5) // (gn.n_lang + 5 * gn.v))::BIGINT AS q
  FROM gn JOIN kt USING (lang) LEFT JOIN kc ON kc.lang = gn.lang AND kc.source = gn.source AND kc.term = kt.term),
pv AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pr AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM gn x JOIN gn y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
r AS (SELECT * FROM pr UNION ALL SELECT lang, source, 'term', term, p - q FROM a WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50
""")
def op11(spark, folder):
    return divergence.divergence(table(spark, folder, "documents"))


BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"


@query("op12_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k,
  first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS best FROM pages)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr({BASE32}, (((('0x' || substr(sha1(t), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN best END AS refers_to
FROM p
""")
def op12(spark, folder):
    return warc.archived_pages(table(spark, folder, "pages"))


@query("op13_fill_in_middle", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT doc_id, text, n, form, array_to_string(u[1 : least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1 : n], '') AS s FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
""")
def op13(spark, folder):
    return fim.fill_in_middle_texts(table(spark, folder, "documents"), texts=False)
