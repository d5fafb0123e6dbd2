"""WARC archives: pages as records, one gzip member each, and a reader that passes over an archive once.

Writing: rows get a row key in a written table; the newest page of every payload is found by two grouped maxima (payloads are salted,
so a payload that a third of all pages share is no hot key) and becomes a response, the others become revisit records without a
payload. A task writes archives below the shared folder, named by what they hold; the returned rows list those that count, so
archives of lost attempts are not read.

Reading: a task inflates an archive piece by piece, frames a record by its content length and compares digests as it goes. It
holds `CHUNK` bytes and one record's headers, whatever a payload's size (unless payloads are asked for).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from stagelight.sources.scratch import scratch_dir

from .media import uri_of
from .text import picked

#: Bytes read or inflated at once.
CHUNK = 1 << 16
#: Compressed bytes after which a task starts another archive.
ARCHIVE = 32 << 20
#: Parts that equal payloads are split into before their newest page is known.
SALTS = 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
#: Characters of a URI that stay as they are; all other bytes are percent-encoded.
URI_SAFE = "!#$%&'()*+,/:;=?@[]~|"


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record_urn(page: str | None, key: int) -> str:
    """Name of the record of a page; `*` stands for a NULL id."""
    return f"<{URN}{'*' if page is None else quote(page, safe='')}:{key}>"


def page_of(urn: str) -> str | None:
    """The page id of a record's name."""
    page = urn.strip("<>").removeprefix(URN).rpartition(":")[0]
    return None if page == "*" else unquote(page)


def http_head(payload_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes


def member(fields: list[tuple[str, str]], block: list[bytes]) -> bytes:
    """One record as one gzip member."""
    digest = hashlib.sha1()
    for part in block:
        digest.update(part)
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32(digest)}"), ("Content-Length", str(sum(map(len, block))))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([z.compress(head.encode()), *map(z.compress, block), z.compress(b"\r\n\r\n"), z.flush()])


def page_record(page: str | None, key: int, url: str | None, payload: bytes, refers: str | None, date: str) -> bytes:
    """A response, or with `refers` (the name of the response) a revisit: HTTP head only, digest and length of the full payload."""
    name = record_urn(page, key)
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", name), ("WARC-Date", date),
              ("WARC-Target-URI", quote(url, safe=URI_SAFE) if url else name.strip("<>")), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{base32(hashlib.sha1(payload))}")]
    if refers:
        return member([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)], [http_head(len(payload))])
    return member(fields, [http_head(len(payload)), payload])


class Archive:
    """An archive that is being written; it gets its name, the digest of its bytes, when it is closed."""

    def __init__(self, store: fs.FileSystem, folder: str, date: str):
        self.store, self.folder, self.part = store, folder, f"{folder}/.{uuid.uuid4().hex}"
        self.out, self.digest, self.size, self.records = store.open_output_stream(self.part), hashlib.sha256(), 0, 0
        self.add(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=0)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], [b"format: WARC File Format 1.1\r\n"]))

    def add(self, record: bytes) -> None:
        self.out.write(record)
        self.digest.update(record)
        self.size += len(record)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        name = f"{self.folder}/{self.digest.hexdigest()}.warc.gz"
        self.store.move(self.part, name)
        return name, self.records, self.size


def repeats(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, salt, best) of the payloads that occur more than once in rows(key, page_id, digest, salt, n_bytes); best is the newest page (page_id, key).

    Equal payloads meet per (digest, salt) first, so no task sees all copies of one payload.
    """
    salted = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "salt").agg(F.max(F.struct("page_id", "key")).alias("best"), F.count("*").alias("n"))
    best = salted.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n")).where("n > 1").select("digest", "best")
    return salted.select("digest", "salt").join(best, "digest")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", text_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row and returns (archive, records, bytes), one row per archive; materialise it once.

    Of rows with equal payloads of at least min_bytes, that with the largest id (NULL is smallest; of repeated rows any one) is
    a response and the others are revisits of it. NULL text is an empty payload, a NULL or empty url is the record's own name; ids are of any type. Texts
    of any length are one record. An empty table gives no archive. Other columns are not read. `folder` is shared, on any file system that Arrow opens.
    """
    spark = pages.sparkSession
    payload = F.coalesce(pages[text_col], F.lit("")).cast("binary")
    url = pages[url_col].cast("string") if url_col else F.lit(None).cast("string")
    rows = picked(pages, page_id=id_col, url=url, payload=payload).withColumn("key", F.monotonically_increasing_id())
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("digest"), salt.alias("salt"), F.octet_length("payload").alias("n_bytes"))
    rows.write.option("compression", "zstd").parquet(f"{folder}/pages")
    rows = spark.read.parquet(f"{folder}/pages")
    repeats(rows, min_bytes).write.parquet(f"{folder}/repeats")  # a written table has a size, so a small one is broadcast and payloads stay where they are
    marked = rows.join(spark.read.parquet(f"{folder}/repeats"), ["digest", "salt"], "left")
    plan = marked.select(F.col("page_id").cast("string"), "key", "url", "payload", F.col("best.page_id").cast("string").alias("to_id"), F.when(F.col("best.key") != F.col("key"), F.col("best.key")).alias("to_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri_of(f"{folder}/archives"))
        store.create_dir(path, recursive=True)
        archive, done = None, []
        for b in batches:
            for page, key, address, body, to_id, to_key in zip(*b.columns):
                archive = archive or Archive(store, path, date)
                to_key = to_key.as_py()
                archive.add(page_record(page.as_py(), key.as_py(), address.as_py(), body.as_py(), None if to_key is None else record_urn(to_id.as_py(), to_key), date))
                if archive.size >= ARCHIVE:
                    done, archive = [*done, archive.close()], None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "records", "bytes"])

    return plan.mapInArrow(run, "archive string, records long, bytes long")


class Members:
    """The gzip members of a stream, one after another; `more` inflates the present one piece by piece."""

    def __init__(self, stream):
        self.stream, self.input, self.offset = stream, b"", 0

    def fill(self) -> bool:
        self.input = self.input or self.stream.read(CHUNK)
        return bool(self.input)

    def next(self) -> bool:
        """Starts the next member; False at the end of the stream."""
        self.inflate = zlib.decompressobj(31)
        return self.fill()

    def more(self) -> bytes:
        """Some bytes of the member, b"" at its end."""
        while not self.inflate.eof:
            there = self.fill()
            out = self.inflate.decompress(self.input, CHUNK)
            rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.offset += len(self.input) - len(rest)
            self.input = rest
            if out:
                return out
            if not there and not self.inflate.eof:
                raise ValueError("the archive ends inside a member")
        return b""


class Body:
    """The decompressed bytes of one member: a head up to a blank line, then a counted number of bytes."""

    def __init__(self, members: Members):
        self.members, self.held = members, b""

    def head(self) -> bytes:
        """Bytes before the first blank line, which is taken off too."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not (more := self.members.more()):
                raise ValueError("a record's head does not end")
            self.held += more
        head, self.held = self.held[:end], self.held[end + 4 :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            piece = self.held or self.members.more()
            if not piece:
                raise ValueError("a record is shorter than its content length")
            self.held, piece = piece[n:], piece[:n]
            n -= len(piece)
            yield piece

    def close(self) -> None:
        rest = self.held + self.members.more()
        while more := self.members.more():
            rest += more
            if len(rest) > 4:
                break
        if rest != b"\r\n\r\n":
            raise ValueError("a record does not end at its content length")


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields, with names in lower case; a line that starts with a blank continues the one before."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def checked(declared: str | None, digest, what: str) -> None:
    """Compares a declared SHA-1 digest; other algorithms are not checked."""
    if declared and declared.lower().startswith("sha1:") and declared[5:].upper() != base32(digest):
        raise ValueError(f"the {what} digest is {declared}, the bytes give {base32(digest)}")


def read_record(members: Members, payloads: bool) -> dict:
    """The record of the present member; raises where its framing or a digest is wrong."""
    body = Body(members)
    version, _, head = body.head().partition(b"\r\n")
    if not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = fields_of(head)
    left, block, payload, kept = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1(), []
    http, start, n = fields.get("content-type", "").startswith("application/http"), b"", 0
    inside = not http
    for piece in body.take(left):
        block.update(piece)
        if not inside:
            start += piece
            end = start.find(b"\r\n\r\n")
            if end < 0:
                continue
            start, piece, inside = start[:end], start[end + 4 :], True
        payload.update(piece)
        n += len(piece)
        if payloads:
            kept.append(piece)
    body.close()
    checked(fields.get("warc-block-digest"), block, "block")
    kind, declared = fields.get("warc-type"), fields.get("warc-payload-digest")
    if kind == "revisit":  # the payload lies in the record it refers to
        n = int(fields_of(start).get("content-length", n))
        digest = declared.partition(":")[2] if declared else None
    else:
        checked(declared, payload, "payload")
        digest = base32(payload)
    return {"type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_bytes": n,
            "payload_digest": digest, "payload": b"".join(kept) if payloads and kind != "revisit" else None}


def records_of(stream, payloads: bool = False) -> Iterator[dict]:
    """All records of an archive in order, each with the offset of its member."""
    members = Members(stream)
    while members.next():
        offset = members.offset
        yield {"offset": offset, **read_record(members, payloads)}


RECORDS = "archive string, offset long, type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_RECORDS = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in RECORDS.split(", ")])


def read_warc(archives: DataFrame, payloads: bool = False, path_col: str = "archive") -> DataFrame:
    """One row per record of all archives: archive, offset, type, record_id, target_uri, refers_to, payload_bytes, payload_digest, payload.

    A revisit has the size and digest of the payload it stands for and a NULL payload; `payload` is NULL throughout unless `payloads`.
    An archive is one task's stream; a damaged one raises an error that names the archive and the record's offset. NULL paths are no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri_of(name))
                rows, size, offset = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    members = Members(stream)
                    try:
                        while members.next():
                            offset = members.offset
                            rows.append({"archive": name, "offset": offset, **read_record(members, payloads)})
                            size += 256 + len(rows[-1]["payload"] or b"")
                            if size >= 1 << 22:
                                yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                                rows, size = [], 0
                    except (ValueError, KeyError, zlib.error) as e:
                        raise ValueError(f"{name}, record at {offset}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    paths = archives.select(archives[path_col].alias("archive")).where("archive IS NOT NULL")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORDS)


def page_records(records: DataFrame, id_type: DataType | str) -> DataFrame:
    """Response and revisit rows under their pages' ids: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def pages(urns):
        def run(x: pa.Array) -> pa.Array:
            return pa.array([None if u is None else page_of(u) for u in x.to_pylist()], pa.string())

        return F.arrow_udf(run, "string")(urns).cast(id_type)

    return records.where(F.col("type").isin("response", "revisit")).select(
        pages(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), pages(F.col("refers_to")).alias("refers_to"))


def archived_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes all pages, then reads the archives back; one row per page with what its record says."""
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark)
    write_warc(pages, folder, min_bytes=min_bytes).write.parquet(f"{folder}/written")
    return page_records(read_warc(spark.read.parquet(f"{folder}/written")), pages.schema["page_id"].dataType)
