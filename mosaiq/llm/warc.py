"""WARC archives: a writer with revisit records, and a splittable reader.

The writer makes one gzip member for each record and one archive for each task,
in a folder that all executors share; an archive gets its name only when it is
whole, so a task that runs again replaces it with the same bytes. The reader
deals byte ranges of the archives to tasks. A task scans its range for the gzip
magic, checks every candidate by inflating it and parsing the WARC header, and
owns the records that start inside its range, wherever they end.

A record's block can hold whole records, which look like candidates to a task
that begins inside it. So of an archive of several ranges each task first follows
its candidate from record to record to the end of its range; where the ranges
meet, one range's end must be the next one's beginning, counted from the start
of the archive, or that range is followed anew from there. What is read is thus
exactly what one reader of the whole archive would read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scratch

MAGIC = b"\x1f\x8b\x08"
#: Bytes of archive in one range, and read at a time.
RANGE, STEP = 16 << 20, 1 << 20
#: Bytes that are read of a candidate at first.
HEAD = 1 << 16

ARCHIVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("records", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("block", T.BinaryType()),
    ]
)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path: a local or mounted folder, or one that pyarrow reaches by its scheme."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_id_of(name: str | None) -> int | None:
    text = (name or "").strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first_url: str | None, level: int = 6) -> bytes:
    """A response record with its HTTP head and payload, or a revisit record with the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = lambda x: "".join(c if c.isprintable() else "%20" for c in (x or "")).strip()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
    ]
    if refers_to is None:
        return record(headers, http + payload, level)
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id(refers_to)),
        ("WARC-Refers-To-Target-URI", clean(first_url)),
    ]
    return record(headers, http, level)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the pages as WARC archives into a shared folder; returns (path, size, records) of the archives.

    Of the records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is a response record, the others
    are revisits of it. A null html is an empty payload, a null url an empty one. Rows with a null page_id are written; they are revisits
    if a page with an id has their payload, and responses otherwise. Repeated rows of one page_id and payload are responses each where
    that page_id is the smallest. An empty table gives no archives. Other columns are not written.
    """
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= least_bytes, F.sha1("payload")))
    # only digests that repeat; counted with a partial aggregate, so a payload that fills a third of the table costs a row for each task
    first = (
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and not first.no")
    )
    first = cut(first, "repeated")  # both sides of the join are plain exchanges then, of which a hot digest can be split
    wide = rows.join(first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "digest", "left")
    wide = wide.select("page_id", "url", "payload", "first_id", "first_url")

    def save(batches):
        from pyspark import TaskContext

        store, top = filesystem(folder)
        store.create_dir(top, recursive=True)
        part = TaskContext.get().partitionId()
        partial, size, count = f"{top}/.part-{part:06d}-{uuid.uuid4().hex}", 0, 0
        out = None
        for batch in batches:
            out = out or store.open_output_stream(partial)
            for p, u, body, f, fu in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first_id", "first_url")), strict=True):
                p, f = p.as_py(), f.as_py()
                member = page_record(p, u.as_py(), body.as_py(), None if f is None or f == p else f, fu.as_py())
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            store.move(partial, f"{top}/part-{part:06d}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part:06d}.warc.gz"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "size", "records"])

    return cut(wide.mapInArrow(save, ARCHIVES), "archives")


class Inflated:
    """Reads a gzip member from a position of a file, no more at a time than asked for."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.z = file, at, size, zlib.decompressobj(31)

    def __iter__(self) -> Iterator[bytes]:
        step = HEAD
        while not self.z.eof and self.at < self.size:
            self.file.seek(self.at)
            raw = self.file.read(min(step, self.size - self.at))
            self.at, step = self.at + len(raw), STEP
            yield self.z.decompress(raw)
        if self.z.eof:
            self.at -= len(self.z.unused_data)


def parse(file, at: int, size: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record whose gzip member starts at a position; None if none starts there."""
    member = Inflated(file, at, size)
    data, split = bytearray(), -1
    try:
        for piece in member:
            data += piece
            if split < 0:
                if not data.startswith(b"WARC/"[: len(data)]):
                    return None
                split = data.find(b"\r\n\r\n", max(0, len(data) - len(piece) - 3))
    except zlib.error:
        return None
    if split < 0 or not member.z.eof:
        return None
    headers = {}
    for line in bytes(data[:split]).decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(data) < split + 4 + int(length):
        return None
    return headers, bytes(data[split + 4 : split + 4 + int(length)]), member.at


def candidate(file, at: int, end: int, size: int, skip=frozenset()) -> tuple[int, tuple[dict[str, str], bytes, int]] | None:
    """The first position in [at, end) where a record can start, with the record; positions in ``skip`` are known not to."""
    while at < end:
        file.seek(at)
        raw = file.read(min(STEP, end - at) + len(MAGIC) - 1)
        hop = raw.find(MAGIC)
        if hop < 0:
            at += max(1, len(raw) - len(MAGIC) + 1)
            continue
        at += hop
        if at >= end:
            return None
        got = None if at in skip else parse(file, at, size)
        if got is not None:
            return at, got
        at += 1
    return None


def walk(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes, int]]:
    """(position, headers, block, next position) of the records that start in [start, end), one after the other from ``start`` on; behind bytes that are no record, from the next candidate on."""
    store, name = filesystem(path)
    with store.open_input_file(name) as file:
        size, at = file.size(), start
        while at < end and (found := candidate(file, at, end, size)):
            place, (headers, block, at) = found
            yield place, headers, block, at


def guess(path: str, start: int, end: int) -> tuple[int, int]:
    """Where a range's first record seems to start, and where the last one that starts in it ends: records that follow each other without a gap to the range's end, or (-1, -1)."""
    store, name = filesystem(path)
    with store.open_input_file(name) as file:
        size, at, bad = file.size(), start, set()
        while found := candidate(file, at, end, size, bad):
            first, (_, _, now) = found
            chain = [first]
            while first not in bad and now < min(end, size):
                got = None if now in bad else parse(file, now, size)
                if got is None:  # a gap: these records stand inside another one, or the archive is damaged
                    bad.update(chain)
                else:
                    chain.append(now)
                    now = got[2]
            if first not in bad:
                return first, now
            at = first + 1
    return -1, -1


def read(spark: SparkSession, archives: DataFrame, span: int = RANGE) -> DataFrame:
    """All records of the archives (path, size): path, start, headers (names in lower case) and block.

    Empty archives and an empty table have none. Bytes that are no record, as after an archive that was cut off, are skipped.
    """
    last = F.floor((F.col("size") - 1) / span).cast("long")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = archives.where((F.col("size") > 0) & (F.col("size") <= span)).select("path", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    ranges = archives.where(F.col("size") > span).select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    ranges = ranges.select("path", (F.col("k") * span).alias("start"), F.least(F.col("size"), (F.col("k") + 1) * span).alias("end"))

    def look(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [guess(r["path"], r["start"], r["end"]) for r in rows]
            ends = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), batch.column("end"), *ends], ["path", "start", "end", "first", "next"])

    def settle(parts: pd.DataFrame) -> pd.DataFrame:  # one archive's ranges, a row each
        at, out = 0, []
        for r in parts.sort_values("start").itertuples():
            if at >= r.end:
                continue
            out.append((r.path, at, r.end))
            if r.first == at:
                at = r.next
            else:
                at = max([x[3] for x in walk(r.path, at, r.end)], default=r.end)
        return pd.DataFrame(out, columns=["path", "start", "end"])

    kind = "path string, start bigint, end bigint"
    looked = ranges.repartition(width, "path", "start").mapInArrow(look, f"{kind}, first bigint, next bigint")
    settled = looked.groupBy("path").applyInPandas(settle, kind)

    def load(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held, held_bytes = [], 0
                for at, headers, block, _ in walk(row["path"], row["start"], row["end"]):
                    held.append((row["path"], at, list(headers.items()), block))
                    held_bytes += len(block)
                    if held_bytes > 4 * STEP:
                        yield pack(held)
                        held, held_bytes = [], 0
                if held:
                    yield pack(held)

    def pack(rows):
        kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], RECORDS.names)

    return whole.union(settled).repartition(width, "path", "start").mapInArrow(load, RECORDS)


def page_rows(records: DataFrame) -> DataFrame:
    """What the archives say of each page: page_id, payload_bytes, payload_digest, record_type, refers_to. The digest of a whole payload is computed anew and must agree."""
    schema = T.StructType(
        [
            T.StructField("page_id", T.LongType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_digest", T.StringType()),
            T.StructField("record_type", T.StringType()),
            T.StructField("refers_to", T.LongType()),
        ]
    )

    def derive(batches):
        for batch in batches:
            rows = []
            for headers, block in zip(batch.column("headers"), batch.column("block"), strict=True):
                h, block = dict(headers.as_py()), block.as_py()
                head, _, payload = block.partition(b"\r\n\r\n")
                fields = dict(x.lower().split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (sha1_base32(payload) != digest or len(payload) != int(fields["content-length"])):
                    raise ValueError(f"{h.get('warc-record-id')}: the payload doesn't match its digest")
                rows.append((page_id_of(h.get("warc-record-id")), int(fields["content-length"]), digest, h["warc-type"], page_id_of(h.get("warc-refers-to"))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    return records.select("headers", "block").mapInArrow(derive, schema)


def round_trip(pages: DataFrame, span: int = RANGE) -> DataFrame:
    """Write the pages to the shared folder and read the archives back; an error if a record is missing or there is one too many."""
    spark = pages.sparkSession
    archives = write(pages, scratch(spark, "warc"))
    rows = cut(page_rows(read(spark, archives, span)), "records")
    written = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if (got := rows.count()) != written:
        raise ValueError(f"{written} records were written, {got} read")
    return rows


def sql() -> str:
    """What a round trip says of each page, in DuckDB SQL; base 32 takes 5 bits, which two hexadecimal digits hold, for each letter."""
    digit = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
    bits = f"({digit.format('5 * i // 4 + 1')} * 16 + greatest({digit.format('5 * i // 4 + 2')}, 0)) >> CAST(3 - 5 * i % 4 AS INT) & 31"
    return f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({bits}) AS INT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id OR page_id IS NULL THEN first_id END AS refers_to FROM f"""
