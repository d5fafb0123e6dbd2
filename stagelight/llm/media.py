"""Media columns: payloads as grey PNG images in tar shards; rows carry digest, offset and length.

A task writes the distinct payloads of its rows to tar shards below the shared folder, named by what they hold, so a repeated
task writes the same shard again. Rows go to a written table before any is read back; the header columns come from range
reads of a member's first bytes, the payload columns from the whole member.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.sources.scratch import scratch_dir

from .text import picked, slices

#: Bytes in an image row, which is also what payloads are padded to.
WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A member's bytes up to the end of its header chunk.
HEADER = 33
#: Bytes of members in a shard.
SHARD = 32 << 20


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A grey 8-bit PNG whose samples are the payload."""
    rows = len(payload) // WIDTH
    raw = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", start[16:25])


def decode(image: bytes) -> bytes:
    """The samples of an image made by `encode`; checks every chunk's sum."""
    width, height, _ = header(image[:HEADER])
    at, data = 8, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if zlib.crc32(image[at + 4 : at + 8 + n]) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        data += image[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    raw = zlib.decompress(data)
    return b"".join(raw[i + 1 : i + 1 + width] for i in range(0, height * (width + 1), width + 1))


def feature(payload: bytes) -> str:
    """Height, mean level and the shares of eight level ranges in ten-thousandths."""
    counts = [0] * 256
    for level in set(payload):
        counts[level] = payload.count(level)
    n = len(payload)
    shares = "-".join(str(round(10000 * sum(counts[i : i + 32]) / n)) for i in range(0, 256, 32))
    return f"h{n // WIDTH}:m{sum(i * c for i, c in enumerate(counts)) * 1000 // n}:{shares}"


class Shard:
    """Members of one tar shard in memory until it is full; at most SHARD bytes and one member."""

    def __init__(self):
        self.buffer, self.rows, self.at = io.BytesIO(), [], {}
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)

    def add(self, media: bytes) -> tuple[str, int, int]:
        digest = hashlib.sha256(media).hexdigest()
        if digest not in self.at:
            info = tarfile.TarInfo(digest + ".png")
            info.size = len(media)
            self.tar.addfile(info, io.BytesIO(media))
            self.at[digest] = self.buffer.tell() - len(media) - (-len(media) % 512)
        return digest, self.at[digest], len(media)

    def write(self, store: fs.FileSystem, folder: str) -> str:
        self.tar.close()
        body = self.buffer.getvalue()
        name = f"{folder}/{hashlib.sha256(body).hexdigest()}.tar"
        part = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(body)
        store.move(part, name)
        return name


STORED = "doc_id long, n_bytes long, shard string, digest string, offset long, length long"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("shard", pa.string()), ("digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def uri_of(folder: str) -> str:
    return folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the payloads of all rows; one row per input row with doc_id, n_bytes, shard, digest, offset and length.

    NULL and empty texts are one row of blanks. Equal payloads have equal digests and lie once in a shard; a very long text is
    a member of any size. `folder` is shared and any file system that Arrow opens. The result must be materialised once.
    """

    def run(batches):
        store, path = fs.FileSystem.from_uri(uri_of(folder))
        store.create_dir(path, recursive=True)
        shard, seen = Shard(), {}

        def close():
            name = shard.write(store, path)
            cols = list(zip(*[(i, n, name, *where) for i, n, where in shard.rows]))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STORED)], schema=_STORED)

        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in slices(b.column(1)):
                for i, text in enumerate(texts):
                    key = hashlib.sha256(text).digest()
                    if key not in seen:
                        seen[key] = shard.add(encode(padded(text)))
                    shard.rows.append((ids[first + i], len(text), seen[key]))
                    if shard.buffer.tell() >= SHARD:
                        yield close()
                        shard, seen = Shard(), {}
        if shard.rows:
            yield close()

    return picked(docs, doc_id=docs[id_col].cast("long"), text=text_col).mapInArrow(run, STORED)


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, bits int"
_MEDIA = pa.schema([(p.split()[0], {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[p.split()[1]]) for p in MEDIA.split(", ")])


def read_header(f, offset: int) -> tuple[int, int, int]:
    """Header columns of a member by a range read of its first bytes."""
    f.seek(offset)
    return header(f.read(HEADER))


def read_media(stored: DataFrame, folder: str) -> DataFrame:
    """Columns read back from the shards of `folder`, one row per stored row; a task reads each of its members once."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(uri_of(folder))
        name = f = None
        done: dict[int, tuple] = {}
        for b in batches:
            out = []
            for doc_id, n_bytes, shard, digest, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if shard != name:
                    if f is not None:
                        f.close()
                    f, name, done = store.open_input_file(shard), shard, {}
                if offset not in done:
                    width, height, bits = read_header(f, offset)
                    f.seek(offset)
                    media = f.read(length)
                    if hashlib.sha256(media).hexdigest() != digest:
                        raise ValueError(f"{shard}: member at {offset} is not {digest}")
                    payload = decode(media)
                    done[offset] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), length, digest, feature(payload), width, height, bits)
                out.append((doc_id, n_bytes, *done[offset]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _MEDIA)], schema=_MEDIA)
        if f is not None:
            f.close()

    return stored.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(run, MEDIA)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store all payloads, then read them back: doc_id, sizes, digests, tail sum, feature and header columns of every row."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    store_media(docs, f"{folder}/shards").write.parquet(f"{folder}/rows")
    return read_media(spark.read.parquet(f"{folder}/rows"), f"{folder}/shards")
