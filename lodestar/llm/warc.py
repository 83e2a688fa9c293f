"""WARC archives, index first.

Records are written as gzip members, one after another, and each file's index (offset, length, URL, digest of every
record) is a table of its own. It is the index that commits a write: a task's file has a name of its own attempt, and
only files named by the committed index are ever read, so tasks may be lost and repeated. Reading takes index rows,
sorts them by file and offset, merges neighbouring byte ranges into few reads, and parses the records found there.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import slices
from lodestar.session import cut, shared_dir

#: Payloads of fewer bytes are written in full even if they repeat.
MIN_REVISIT = 100
#: A new file is begun beyond so many bytes; ranges no further apart than GAP are read at once, up to READ bytes.
FILE, GAP, READ = 256 << 20, 64 << 10, 8 << 20
#: Digests that occur more than once are broadcast if they are so many at most, some 10 MB.
FEW = 100_000
#: Payloads are written and handed on in batches of about so many bytes (one payload at least).
BATCH = 4 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType())])
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("payload", T.BinaryType())])


def _quoted(value: str) -> str:
    """A header value on one line; percent signs and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _unquoted(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    block = _HTTP if revisit else _HTTP + payload
    name = uuid.UUID(hashlib.sha256(f"{page_id} {url} {digest}".encode()).hexdigest()[:32])
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", _quoted(url))] if url is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head += [("WARC-Profile", PROFILE)] if revisit else []
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    head += [("X-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def parse(data: bytes) -> tuple[int | None, str | None, str, int | None, str, bytes | None]:
    """``(page_id, url, type, refers_to, digest, payload)`` of one record; a revisit has no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    if len(block) != int(field["content-length"]):
        raise ValueError("a record ends early")
    number = lambda k: int(field[k]) if k in field else None
    url = field.get("warc-target-uri")
    kind = field["warc-type"]
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
    return number("x-page-id"), None if url is None else _unquoted(url), kind, number("x-refers-to-page-id"), field["warc-payload-digest"].partition(":")[2], payload


_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.dataType]) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


def _store(uri: str):
    return fs.FileSystem.from_uri(uri)


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, revisit, refers_to)`` for every row.

    Of rows with equal payloads of MIN_REVISIT bytes or more, those with the smallest page_id are responses. Which one that
    is is found from digests of such payloads that occur more than once, counted before they are shuffled.
    """
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = base.where(F.octet_length("payload") >= MIN_REVISIT)
    again = cut(long.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select(F.col("digest").alias("d"), "first"))
    if again.count() <= FEW:  # payloads stay where they are; otherwise they are shuffled by digest
        again = F.broadcast(again)
    joined = base.join(again, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= MIN_REVISIT), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes an archive of ``pages`` below ``folder``, a URI that executors share, and returns its index.

    Null html is an empty payload, a null URL or page_id is left out of its record and comes back null. Of equal
    payloads of at least 100 bytes, the rows of the smallest page_id (a null one is larger than any) are responses,
    also where that row is repeated; all others are revisits. Other columns are not written. An empty table gives an empty
    index.
    """

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for start, part in slices(batch.column("payload").cast(pa.large_binary()), BATCH):
                rows = []
                for r in batch.slice(start, len(part)).to_pylist():
                    if out is None or at > FILE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"])) + squeeze.flush()
                    out.write(member)
                    rows.append((name, at, len(member), r["url"], r["digest"], r["page_id"], "revisit" if r["revisit"] else "response"))
                    at += len(member)
                # index rows of a file that is still open are seen by no one before the task, and so the file, is complete
                yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    plan(pages, page_id, url, html).mapInArrow(written, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of some index rows: ``(page_id, url, record_type, refers_to, digest, payload)``.

    Every record's digest is held against that of the index; a difference fails the task. A repeated index row gives
    its record as often; an empty index gives no rows. Null URLs and page_ids are null. Other columns of ``index`` play
    no part. Payloads are handed on in batches of bounded size, whatever they were compressed to.
    """

    def ranges(rows: list[dict]) -> Iterator[list[dict]]:
        group: list[dict] = []
        for r in rows:
            if group and (r["file"] != group[0]["file"] or r["offset"] > group[-1]["offset"] + group[-1]["length"] + GAP or r["offset"] + r["length"] > group[0]["offset"] + READ):
                yield group
                group = []
            group.append(r)
        if group:
            yield group

    def fetched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        opened, source = None, None
        for batch in batches:
            for group in ranges(batch.to_pylist()):
                if opened != group[0]["file"]:
                    if source is not None:
                        source.close()
                    opened, source = group[0]["file"], store.open_input_file(f"{path}/{group[0]['file']}")
                start = group[0]["offset"]
                data = source.read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                found, held = [], 0
                for r in group:
                    at = r["offset"] - start
                    got = parse(zlib.decompress(data[at : at + r["length"]], 31))
                    if got[4] != r["digest"]:
                        raise ValueError(f"{r['file']} at {r['offset']}: another record than the index says")
                    found.append(got)
                    held += len(got[5] or b"")
                    if held > BATCH:
                        yield _batch(found, RECORD)
                        found, held = [], 0
                if found:
                    yield _batch(found, RECORD)
        if source is not None:
            source.close()

    wanted = index.select("file", "offset", "length", "digest")
    return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetched, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` and reads all records back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Length and digest of a response are those of the payload read; a revisit has those of the response with its digest.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    found = read(write(pages, folder), folder).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha"))
    found = cut(found)
    original = found.where("record_type = 'response'").groupBy(F.col("digest").alias("d")).agg(F.max("bytes").alias("o_bytes"), F.max("sha").alias("o_sha"))
    revisits = found.where("record_type = 'revisit'").join(original, F.col("digest") == F.col("d"), "left").select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_sha").alias("payload_digest"), "record_type", "refers_to")
    return found.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to").unionByName(revisits)
