"""Fill-in-middle over seekable compressed frames.

A text is stored as zstandard frames that are compressed one by one; its index row has, for every frame, where it lies and how
many units and characters stand before it. A cut after u units needs only the frame that holds unit u: the index names it, and
that frame alone is decompressed to find the byte. Outputs are frames too, streamed from the ranges of the source in their new order;
their digests, and the text restored from an output, come from streams of frames in order. Shards of frames lie below the shared
folder, named by what they hold, and only index rows are shuffled (a task reads whole shards). A task holds one frame of a text besides the
compressed shard it writes; a text's frames lie in one shard.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame

from stagelight.sources.scratch import scratch_dir

from .media import uri_of
from .text import picked

#: Bytes of text in a frame.
FRAME = 1 << 14
#: Compression level; a text of some kilobytes is one small frame, which gains from a thorough search.
LEVEL = 12
#: Compressed bytes after which a shard is closed.
SHARD = 16 << 20
#: Bytes read ahead of a wanted frame.
AHEAD = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Kind of each byte: 0 continues a character, 1 starts a character that is a unit of its own, 2 is a letter A-Z or a-z.
KIND = np.array([2 if 65 <= b <= 90 or 97 <= b <= 122 else 0 if 128 <= b < 192 else 1 for b in range(256)], np.uint8)


def kinds(piece: bytes) -> np.ndarray:
    return KIND[np.frombuffer(piece, np.uint8)]


def unit_starts(kind: np.ndarray, in_word: bool) -> np.ndarray:
    """Which bytes start a unit: each run of letters is one, each other character too; in_word: the byte before is a letter."""
    letter = kind == 2
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    if in_word and len(start):
        start[0] = False
    return start | (kind == 1)


class Shards:
    """Frames of many texts, appended to one buffer until it is full; then a file named by its bytes' digest."""

    def __init__(self, folder: str):
        self.store, self.path = fs.FileSystem.from_uri(uri_of(folder))
        self.store.create_dir(self.path, recursive=True)
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.buffer, self.rows = bytearray(), []

    def put(self, pieces: Iterable[bytes]) -> tuple[list[int], list[int]]:
        """Stores pieces as one frame each; (offsets, sizes)."""
        offset, size = [], []
        for p in pieces:
            frame = self.press.compress(p)
            offset.append(len(self.buffer))
            size.append(len(frame))
            self.buffer += frame
        return offset, size

    @property
    def full(self) -> bool:
        return len(self.buffer) >= SHARD

    def close(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Writes the shard and gives its rows, with the shard's name in the first column."""
        if not self.rows:
            return
        body = bytes(self.buffer)
        name, part = f"{self.path}/{hashlib.sha256(body).hexdigest()}.frames", f"{self.path}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as out:
            out.write(body)
        self.store.move(part, name)
        rows, self.buffer, self.rows = self.rows, bytearray(), []
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]], schema=schema)


class Frames:
    """Frames of shards by range reads; keeps the bytes around the last read and the last frame."""

    def __init__(self, folder: str):
        self.store, _ = fs.FileSystem.from_uri(uri_of(folder))
        self.name = self.file = self.last = None
        self.low, self.held = 0, b""
        self.press = zstandard.ZstdDecompressor()

    def frame(self, shard: str, offset: int, size: int) -> bytes:
        if self.last and self.last[0] == (shard, offset):
            return self.last[1]
        if shard != self.name:
            self.close()
            self.file, self.name, self.held = self.store.open_input_file(shard), shard, b""
        if not self.low <= offset <= offset + size <= self.low + len(self.held):
            self.file.seek(offset)
            self.low, self.held = offset, self.file.read(max(size, AHEAD))
        at = offset - self.low
        self.last = (shard, offset), self.press.decompress(self.held[at : at + size])
        return self.last[1]

    def span(self, shard: str, offset: list[int], size: list[int], low: int, high: int) -> Iterator[bytes]:
        """The bytes [low, high) of a text, frame by frame."""
        for k in range(low // FRAME, -(-high // FRAME) if high > low else 0):
            yield self.frame(shard, offset[k], size[k])[max(0, low - k * FRAME) : high - k * FRAME]

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.file = None


def schema_of(ddl: str) -> pa.Schema:
    kind = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "int": pa.int32()}
    return pa.schema([(f.split()[0], kind[f.split()[1]]) for f in ddl.split(", ")])


#: Frames of a text: place and size of each, units and characters before it, whether its first byte continues a word; totals; whether the text holds a mark.
INDEX = "shard string, doc_id string, offset array<long>, size array<long>, units array<long>, chars array<long>, in_word array<boolean>, n_units long, n_chars long, n_bytes long, marked boolean"
_INDEX = schema_of(INDEX)


def framed(text: bytes) -> list[bytes]:
    return [text[i : i + FRAME] for i in range(0, len(text), FRAME)]


def counted(frames: list[bytes]) -> tuple[list[int], list[int], list[bool], int, int]:
    """(units before, characters before, continues a word) of every frame, and the totals."""
    units, chars, inside, n, c, word = [], [], [], 0, 0, False
    for f in frames:
        kind = kinds(f)
        units.append(n)
        chars.append(c)
        inside.append(word)
        n += int(np.count_nonzero(unit_starts(kind, word)))
        c += int(np.count_nonzero(kind))
        word = bool(kind[-1] == 2)
    return units, chars, inside, n, c


def store_frames(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts; one index row per input row (id as a string). NULL and empty texts have no frames. Materialise the result once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder)
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            for doc_id, text in zip(b.column(0).to_pylist(), texts):
                text = text.as_py() or b""
                frames = framed(text)
                units, chars, inside, n, c = counted(frames)
                shards.rows.append((doc_id, *shards.put(frames), units, chars, inside, n, c, len(text), any(m in text for m in (PREFIX, SUFFIX, MIDDLE))))
                if shards.full:
                    yield from shards.close(_INDEX)
        yield from shards.close(_INDEX)

    return picked(docs, doc_id=docs[id_col].cast("string"), text=docs[text_col]).mapInArrow(run, INDEX)


def draws(doc_id: str | None, salt: str) -> list[int]:
    """h1 to h4 of an id; a NULL id counts as an empty one."""
    digest = hashlib.sha256(f"{salt}:{doc_id or ''}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut_place(frames: Frames, row: dict, unit: int) -> tuple[int, int]:
    """(byte, character) before which `unit` units stand; reads the one frame in which unit number `unit` starts."""
    if unit >= row["n_units"]:
        return row["n_bytes"], row["n_chars"]
    k = bisect_right(row["units"], unit) - 1
    kind = kinds(frames.frame(row["shard"], row["offset"][k], row["size"][k]))
    at = int(np.flatnonzero(unit_starts(kind, row["in_word"][k]))[unit - row["units"][k]])
    return k * FRAME + at, row["chars"][k] + int(np.count_nonzero(kind[:at]))


def reframed(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces of FRAME bytes."""
    held = b""
    for p in pieces:
        held += p
        while len(held) >= FRAME:
            yield held[:FRAME]
            held = held[FRAME:]
    if held:
        yield held


OUTPUT = "shard string, doc_id string, offset array<long>, size array<long>, n_bytes long, n long, form string, prefix_chars long, middle_chars long"
_OUTPUT = schema_of(OUTPUT)


def by_shard(rows: DataFrame) -> DataFrame:
    """Rows dealt so that a shard is read by one task, in the order it was written."""
    shards = rows.select("shard").distinct().count()
    return rows.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "offset")


def fill_in_middle(index: DataFrame, folder: str, salt: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Outputs of all indexed texts as frames below `folder`; one row per index row with form, cuts and the output's frames. Materialise once.

    A plain output is its text and keeps the text's frames.

    h1 to h4 are the first 8-digit groups of the hex sha256 of salt:id. Texts that are empty, hold a mark or have h3 % 100 >=
    plain_from stay plain; of the others those with h4 % 100 < spm_below are suffix first. Equal rows give equal outputs; a NULL id is cut like an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, frames = Shards(folder), Frames(folder)
        for b in batches:
            plain = []
            for row in b.to_pylist():
                h1, h2, h3, h4 = draws(row["doc_id"], salt)
                n, end = row["n_units"], row["n_bytes"]
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))

                def span(low: int, high: int, row=row) -> Iterator[bytes]:
                    return frames.span(row["shard"], row["offset"], row["size"], low, high)

                if n == 0 or row["marked"] or h3 % 100 >= plain_from:
                    plain.append((row["shard"], row["doc_id"], row["offset"], row["size"], end, n, "plain", None, None))
                    continue
                (a, a_chars), (z, z_chars) = cut_place(frames, row, first), cut_place(frames, row, last)
                prefix, suffix = [[PREFIX], span(0, a)], [[SUFFIX], span(z, end)]
                form, start = ("spm", suffix + prefix) if h4 % 100 < spm_below else ("psm", prefix + suffix)
                place = shards.put(reframed(p for part in [*start, [MIDDLE], span(a, z)] for p in part))
                shards.rows.append((row["doc_id"], *place, end + len(PREFIX + SUFFIX + MIDDLE), n, form, a_chars, z_chars - a_chars))
                if shards.full:
                    yield from shards.close(_OUTPUT)
            if plain:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*plain), _OUTPUT)], schema=_OUTPUT)
        yield from shards.close(_OUTPUT)
        frames.close()

    return by_shard(index).mapInArrow(run, OUTPUT)


def marks_in(pieces: Iterable[bytes], marks: tuple[bytes, ...]) -> Iterator[tuple[int, bytes]]:
    """(place, mark) of every mark in a stream of pieces, in order."""
    tail, at = b"", 0
    for p in pieces:
        text = tail + p
        yield from sorted((i, m) for m in marks for i in places(text, m, at - len(tail)))
        at += len(p)
        tail = text[-2:]


def places(text: bytes, mark: bytes, base: int) -> Iterator[int]:
    i = text.find(mark)
    while i >= 0:
        yield base + i
        i = text.find(mark, i + len(mark))


def restored_ranges(form: str, n_bytes: int, found: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Ranges of an output that give the text in order, from the form and the marks found in the output."""
    if form == "plain":
        return [(0, n_bytes)]
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    if tuple(m for _, m in found) != order or found[0][0]:
        raise ValueError(f"no output of form {form}")
    ends = [i for i, _ in found[1:]] + [n_bytes]
    part = {m: (i + len(m), e) for (i, m), e in zip(found, ends)}
    return [part[m] for m in (PREFIX, MIDDLE, SUFFIX)]


READ = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string, restored string"
_READ = schema_of(READ)


def read_outputs(outputs: DataFrame, folder: str, texts: bool = False) -> DataFrame:
    """Digests of every output and of the text restored from it; with `texts` also both texts (else NULL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(folder)
        for b in batches:
            out = []
            for row in b.to_pylist():

                def span(low: int, high: int, row=row) -> Iterator[bytes]:
                    return frames.span(row["shard"], row["offset"], row["size"], low, high)

                whole, back, end = hashlib.sha256(), hashlib.sha256(), row["n_bytes"]

                def hashed(pieces: Iterable[bytes], whole=whole) -> Iterator[bytes]:
                    for p in pieces:
                        whole.update(p)
                        yield p

                found = list(marks_in(hashed(span(0, end)), (PREFIX, SUFFIX, MIDDLE)))
                ranges = restored_ranges(row["form"], end, found)
                for low, high in ranges:
                    for p in span(low, high):
                        back.update(p)
                both = [b"".join(p for r in rs for p in span(*r)).decode() for rs in ([(0, end)], ranges)] if texts else (None, None)
                out.append((row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"], whole.hexdigest(), back.hexdigest(), *both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ)], schema=_READ)
        frames.close()

    return by_shard(outputs).mapInArrow(run, READ)


def fill_in_middle_texts(docs: DataFrame, folder: str | None = None, texts: bool = True, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Stores, cuts and reads back all rows: id, n, form, prefix_chars, middle_chars, both digests and (with `texts`) output and restored text.

    One row per input row, repeated rows too; NULL text is empty, an empty text is plain. Ids of any type keep it. A very long text is many frames,
    a very long word spans frames. Other columns are not read; an empty table gives no row. `folder` is shared. `options` go to `fill_in_middle`.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    store_frames(docs, f"{folder}/texts", id_col, text_col).write.parquet(f"{folder}/index")
    fill_in_middle(spark.read.parquet(f"{folder}/index"), f"{folder}/outputs", **options).write.parquet(f"{folder}/cut")
    got = read_outputs(spark.read.parquet(f"{folder}/cut"), f"{folder}/outputs", texts)
    return got.withColumn("doc_id", got["doc_id"].cast(docs.schema[id_col].dataType)).drop(*([] if texts else ["output", "restored"]))
