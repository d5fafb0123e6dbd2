"""Illumination events and fluidics protocols from XML."""

from __future__ import annotations

import itertools
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight import schemas
from stagelight.functions.scalar import round_even
from stagelight.sources.scratch import open_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, channel) of every event with both fields; two events on one frame are an error at run time."""
    raw = spark.read.format("xml").option("rowTag", "event").schema(schemas.EVENT_XML).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    e = raw.where("`on` is not null and channel is not null").select(
        "file", round_even(F.col("on").cast("double")).cast("int").alias("frame"), F.col("channel").cast("int").alias("channel"))
    g = e.groupBy("file", "frame").agg(F.max("channel").alias("channel"), F.count(F.lit(1)).alias("_n"))
    return g.select("file", "frame", F.when(F.col("_n") == 1, F.col("channel")).otherwise(
        F.raise_error(F.concat(F.lit("two events on frame "), F.col("frame").cast("string"))).cast("int")).alias("channel"))


def parse_z_offsets(text: DataFrame, column: str = "value") -> DataFrame:
    """(file, frame, z): the numbers of the z offset list, in order; a file without one is an error."""
    body = F.regexp_extract(column, r"(?s)<z_offsets[^>]*>(.*?)</z_offsets>", 1)
    nums = F.regexp_extract_all(body, F.lit(r"([-+]?\d*\.?\d+)"), F.lit(1))
    ok = F.when(F.trim(body) != "", nums).otherwise(F.raise_error(F.concat(F.lit("no z offsets in "), F.col("file"))).cast("array<string>"))
    return text.select("file", F.posexplode(ok).alias("frame", "_z")).select("file", "frame", F.col("_z").cast("double").alias("z"))


def read_settings(text: DataFrame, tags: list[str], column: str = "value") -> DataFrame:
    """(file, one column per tag): first number of each tag, NULL when absent."""
    return text.select("file", *[
        F.nullif(F.regexp_extract(column, rf"<{t}[^>]*>\s*([-+\d.]+)\s*</{t}>", 1), F.lit("")).cast("double").alias(t) for t in tags])


def elements(chunks: Iterable[bytes | str]) -> Iterator[tuple[list[ET.Element], ET.Element]]:
    """(open ancestors, element) at the end of every element; ended elements are taken off their parent, so a document is never held as a whole."""
    parser, ancestors = ET.XMLPullParser(("start", "end")), []

    def ended() -> Iterator[tuple[list[ET.Element], ET.Element]]:
        for event, element in parser.read_events():
            if event == "start":
                ancestors.append(element)
                continue
            ancestors.pop()
            yield ancestors, element
            if ancestors:
                ancestors[-1].remove(element)

    for chunk in chunks:
        parser.feed(chunk)
        yield from ended()
    parser.close()
    yield from ended()


def protocol_steps(chunks: Iterable[bytes | str]) -> Iterator[tuple]:
    """(protocol, pos, kind, name, duration) of the direct children of every protocol element, as they end."""
    seen: Counter = Counter()
    for ancestors, e in elements(chunks):
        if ancestors and ancestors[-1].tag == "protocol":
            protocol = ancestors[-1]
            yield (protocol.get("name") or "").strip(), seen[id(protocol)], e.tag, e.text or "", e.get("duration")
            seen[id(protocol)] += 1
        if e.tag == "protocol":
            del seen[id(e)]


def defined_commands(chunks: Iterable[bytes | str]) -> Iterator[tuple]:
    """(kind, name, pos) of named command definitions; pos counts the definitions of a kind."""
    seen: Counter = Counter()
    for _, e in elements(chunks):
        kind, _, rest = str(e.tag).partition("_")
        if rest == "cmd" and kind in ("valve", "pump"):
            if e.get("name"):
                yield kind, e.get("name").strip(), seen[kind]
            seen[kind] += 1


def document_rows(docs: DataFrame, column: str | None, rows: Callable[[Iterable], Iterator[tuple]], schema: str, chunk: int = 1 << 16) -> DataFrame:
    """The rows of every document behind its `file`: from a content column, or without one streamed from the file itself."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(b.column(0).to_pylist()):
                if column is None:
                    store, place = open_path(name)
                    with store.open_input_stream(place) as stream:
                        yield from in_batches(name, rows(iter(lambda: stream.read(chunk), b"")))
                else:
                    yield from in_batches(name, rows([b.column(1)[i].as_py()]))

    def in_batches(name: str, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while part := list(itertools.islice(found, 10_000)):
            columns = [[name] * len(part), *zip(*part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "INT" else pa.string()) for c, k in zip(columns, kinds)], names=names)

    full = "file STRING, " + schema
    names, kinds = zip(*(f.split() for f in full.split(", ")))
    return docs.select("file", *([column] if column else [])).mapInArrow(parse, full)


def parse_protocols(docs: DataFrame, column: str | None = "content") -> DataFrame:
    """Ordered steps (file, protocol, pos, kind, name, duration) of configuration documents; step names stay verbatim.

    XML comments never become steps. With ``column=None`` documents are streamed from their files in bounded memory.
    """
    return document_rows(docs, column, protocol_steps, schemas.PROTOCOL_STEPS)


def parse_commands(docs: DataFrame, column: str | None = "content") -> DataFrame:
    """Defined commands (file, kind, name, pos) in document order."""
    return document_rows(docs, column, defined_commands, schemas.COMMANDS)


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """Steps of all documents of a folder, file or glob; a document of any size passes through its task in pieces."""
    return parse_protocols(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")), None)


def protocol_durations(steps: DataFrame) -> DataFrame:
    """Seconds per (file, protocol): the sum of numeric durations, others count 0; unnamed protocols are dropped."""
    return steps.where("protocol <> ''").groupBy("file", "protocol").agg(
        F.coalesce(F.sum(F.col("duration").try_cast("double")), F.lit(0.0)).alias("duration_s"))


def valve_pump_steps(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("kind").isin("valve", "pump"))
