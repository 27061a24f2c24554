"""WARC writing, reading and transaction assembly."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_path, fresh_path, saved, scratch

CRLF = "\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORDS = "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, block_bytes long, fields array<string>, payload binary"


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Text of a record without the two line ends that close it; fields whose value is null are left out."""
    lines = [F.lit(VERSION)] + [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_pages(pages: DataFrame, path: str, *, dedup_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", rows_per_file: int = 4096) -> None:
    """Write a request, a response or revisit, and a metadata record for each page row.

    Of rows with equal payloads of ``dedup_bytes`` or more, the one with the largest ``page_id`` is
    written as response and the others as revisits that refer to its record (equal rows that tie on
    the largest id are all responses, and one of them is referred to). Spark's text writer puts the
    records into gzip files (one member each) through its commit protocol, so a lost or repeated
    task leaves no partial archive. Rows are told apart by their place, so ``pages`` must come in
    one order each time that it is read, as files do.

    A null html counts as an empty payload, a null url as ``about:blank``; a null page_id stays
    distinct from every other and never wins against a number.
    """
    # record ids need the row's own number, as page ids may repeat
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit("about:blank")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html").cast("long")})
    # only digests move here; sums are made before the shuffle, so a payload that a third of the rows share costs one row a task
    firsts = rows.where(F.col("bytes") >= dedup_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.max_by("row", "page_id").alias("first_row"), F.count("*").alias("copies"))
    shared = firsts.where((F.col("copies") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id", "first_row")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def name(page: str, row: str, kind: str) -> Column:
        return F.concat(F.lit("<urn:capture:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(":"), F.col(row).cast("string"), F.lit(f":{kind}>"))

    main, asked, about = (name("page_id", "row", kind) for kind in ("main", "request", "metadata"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    head = F.lit(HTTP_OK)
    answer = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    note = F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF))

    def sized(block: Column) -> tuple[str, Column]:
        return "Content-Length", F.octet_length(block).cast("string")

    records = rows.select(
        F.explode(
            F.array(
                _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", asked), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request")), sized(ask)], ask),
                _record(
                    [
                        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
                        ("WARC-Record-ID", main),
                        *common,
                        ("WARC-Payload-Digest", digest),
                        ("WARC-Profile", F.when(revisit, PROFILE)),
                        ("WARC-Refers-To", F.when(revisit, name("first_id", "first_row", "main"))),
                        ("Content-Type", F.lit("application/http; msgtype=response")),
                        sized(answer),
                    ],
                    answer,
                ),
                _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", about), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields")), sized(note)], note),
            )
        ).alias("value")
    )
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


def inflated(raw: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """An archive's bytes in pieces: of its gzip members one after the other, or as they are."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[at : at + piece] for at in range(0, len(raw), piece))
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(raw), piece):
        data = raw[at : at + piece]
        while data:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(data)
            data = member.unused_data


class _Source:
    """Bytes that come in pieces, read forward; memory holds a piece and the record asked for."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.kept, self.pos = pieces, b"", 0

    def _more(self) -> bool:
        data = next(self.pieces, None)
        if data is None:
            return False
        self.kept, self.pos = self.kept[self.pos :] + data, 0
        return True

    def until(self, end: bytes) -> bytes | None:
        while (found := self.kept.find(end, self.pos)) < 0:
            if not self._more():
                return None
        out, self.pos = self.kept[self.pos : found], found + len(end)
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while True:
            part = self.kept[self.pos : self.pos + n - have]
            parts.append(part)
            have += len(part)
            self.pos += len(part)
            if have >= n or not self._more():
                return b"".join(parts)


def parse(pieces: Iterator[bytes], payload: bool = True) -> Iterator[tuple]:
    """Records of one archive, as in ``RECORDS``. The payload of an HTTP message is what follows its header."""
    source = _Source(iter(pieces))
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            continue
        fields: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())

        def one(name: str, own: dict = fields) -> str | None:
            return own.get(name, [None])[0]

        n = int(one("content-length") or 0)
        block = source.take(n)
        body = block
        if (one("content-type") or "").startswith("application/http"):
            body = block.partition(b"\r\n\r\n")[2]
        kind = one("warc-type")
        yield (one("warc-record-id"), kind, one("warc-target-uri"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-payload-digest") if kind == "revisit" else f"sha1:{hashlib.sha1(body).hexdigest()}", len(body), n, body.decode("utf-8", "replace").split(CRLF)[:-1] if one("content-type") == "application/warc-fields" else None, body if payload else None)


def _record_batches(rows: Iterator[tuple], payload: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 300 + row[7] * payload
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*held), types)], names=names)


def read(spark: SparkSession, path: str, *, payload: bool = True, most_whole: int = 32 << 20) -> DataFrame:
    """Read archives (gzip files, of a member a record or fewer, or plain ones) as one row per record.

    Digest and length of a payload are computed from the bytes read; a revisit has no payload and
    keeps the digest that it states. Files come to the tasks as they are and are inflated a piece
    at a time; gzip files of more than ``most_whole`` bytes, which might be too much for that, are
    inflated by Spark instead and come in pieces. Both give the same rows. Plain files must fit
    into a task (2 GB at most).
    """
    end = CRLF + CRLF

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                number, values = batch.column(0).to_numpy(), batch.column(1)
                cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
                for at, to in zip(cuts, cuts[1:]):  # what comes of one file, joined as it was
                    if to > at:
                        yield number[at], end.encode().join([*values[at:to].to_pylist(), b""])

        files = groupby(pieces(), key=lambda x: x[0])  # a file's pieces follow each other in one task
        yield from _record_batches((row for _, own in files for row in parse((data for _, data in own), payload)), payload)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _record_batches((row for batch in batches for content in batch.column(0) for row in parse(inflated(content.as_py()), payload)), payload)

    some = spark.read.format("binaryFile").load(path).where((F.col("length") <= most_whole) | ~F.col("path").endswith(".gz")).select("content")
    large = spark.read.option("lineSep", end).option("pathGlobFilter", "*.gz").text(path).where(F.col("_metadata.file_size") > most_whole)
    parts = large.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return some.mapInArrow(whole, RECORDS).unionByName(parts.mapInArrow(streamed, RECORDS))


ANSWERS = ("response", "revisit", "resource", "conversion")


def _resolved(answers: DataFrame, others: DataFrame) -> DataFrame:
    """``record_id, capture_id`` of the other records: what the references of either side lead to, followed to an answer or to something that the archive lacks or that names nothing."""
    given = others.select("record_id", F.explode("concurrent_to").alias("capture_id"))
    taken = answers.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id"))
    links = given.unionByName(taken).where("record_id IS NOT NULL AND capture_id IS NOT NULL AND record_id != capture_id").distinct()
    onward = links.join(answers.select("record_id").distinct(), "record_id", "left_anti")  # an answer is where a reference ends
    steps = onward.select(F.col("record_id").alias("via"), F.col("capture_id").alias("next"))
    open_ = onward.join(steps.select("via").distinct(), F.col("capture_id") == F.col("via"), "left_semi")
    if open_.isEmpty():
        return onward
    links, steps = saved(onward, "links"), saved(steps, "steps")
    seen, done = links, None
    while True:  # as often as the longest chain has steps; a round of records that only name each other ends when nothing new is met
        at = links.join(steps, F.col("capture_id") == F.col("via"), "left")
        ends = at.where(F.col("via").isNull()).select("record_id", "capture_id")
        done = ends if done is None else done.unionByName(ends)
        ahead = at.where(F.col("via").isNotNull()).select("record_id", F.col("next").alias("capture_id")).where("record_id != capture_id").distinct()
        links = saved(ahead.join(seen, ["record_id", "capture_id"], "left_anti"), "links")
        if links.isEmpty():
            return done.distinct()
        seen = saved(seen.unionByName(links), "seen-links")


def assemble(records: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Join request, response and metadata records into one nested row per capture.

    A record belongs to the capture of the record that it is concurrent to, or that says so of it;
    chains of such references, of any length, are followed to the response or revisit at their
    end. Returns ``capture_id``, ``response`` (struct; null if the archive lacks it), ``requests``
    and ``metadata`` (arrays of structs without payload). Request and metadata records that lead to
    nothing found in the archive make captures of their own, named by what they lead to, or by
    themselves; records without any identifier each stand alone. Repeated records and references
    count once. A capture is one row, so its records must fit into one. ``heads`` may hold the
    same records without payload, written out, so that archives aren't read for each step.
    """
    heads = records if heads is None else heads
    answers = records.where(F.col("record_type").isin(*ANSWERS))
    others = heads.where(~F.col("record_type").isin(*ANSWERS, "warcinfo"))
    brief = ["record_id", "record_type", "target_uri", "block_bytes", "payload_bytes", "payload_digest", "fields"]
    named = heads.where(F.col("record_type").isin(*ANSWERS)).select("record_id", "concurrent_to").where("record_id IS NOT NULL")
    found = _resolved(named, others.select("record_id", "concurrent_to")).withColumnRenamed("record_id", "_from")
    linked = others.select(F.struct(*brief).alias("record"))
    followed = linked.join(found, F.col("record.record_id") == F.col("_from"), "left").select("record", F.coalesce("capture_id", F.col("record.record_id")).alias("capture_id"))
    sides = followed.groupBy("capture_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("record.record_type") == "request", F.col("record")))).alias("requests"),
        F.array_sort(F.collect_set(F.when(F.col("record.record_type") != "request", F.col("record")))).alias("metadata"),
    )
    empty = F.array().cast(empty_type(sides))
    nested = ["capture_id", "response", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata")]
    main = answers.select(F.col("record_id").alias("capture_id"), F.struct(*answers.columns).alias("response"))
    joined = main.where(F.col("capture_id").isNotNull()).join(sides.where(F.col("capture_id").isNotNull()), "capture_id", "full")
    alone = main.where(F.col("capture_id").isNull()).withColumns({"requests": F.lit(None).cast(empty_type(sides)), "metadata": F.lit(None).cast(empty_type(sides))})
    lost = sides.where(F.col("capture_id").isNull()).select("capture_id", F.lit(None).cast(main.schema["response"].dataType).alias("response"), "requests", "metadata")
    return joined.unionByName(alone).unionByName(lost).select(*nested)


def empty_type(sides: DataFrame):
    return sides.schema["requests"].dataType


def captures(pages: DataFrame, *, payload: bool = True, path: str | None = None) -> DataFrame:
    """Write pages as WARC files in the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_pages(pages, path)
    heads = saved(read(spark, path, payload=False), "warc-heads")
    return assemble(read(spark, path) if payload else heads, heads)


def page_of(name: Column) -> Column:
    """The page id in a record name made by ``write_pages``; null where it has none."""
    return F.regexp_extract(name, r"^<urn:capture:(-?\d+):", 1).try_cast("long")


def page_digests(pages: DataFrame) -> DataFrame:
    """One row per page as read back: digest and size of the full payload, record type, and whom a revisit refers to.

    A revisit carries no payload; its size comes from the metadata record assembled with it. The
    archives go when the digests are written.
    """
    with scratch():
        path = fresh_path(pages.sparkSession, "warc")
        try:
            return saved(_digests(captures(pages, payload=False, path=path).where(F.col("response").isNotNull())), "page-digests", outlive=True)
        finally:
            forget_path(pages.sparkSession, path)


def _digests(found: DataFrame) -> DataFrame:
    stated = F.regexp_extract(F.get(F.get(F.col("metadata.fields"), F.lit(0)), F.lit(0)), r"^payloadBytes: (\d+)$", 1).try_cast("long")
    return found.select(
        page_of(F.col("capture_id")).alias("page_id"),
        F.when(F.col("response.record_type") == "revisit", stated).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.regexp_replace("response.payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
        F.size("metadata").cast("long").alias("n_metadata"),
    )
