"""WARC archives: writing, normalising whole-file gzip to a member for each record, and reading by offset.

Archives are rows (archive, data) of a Spark table, so any store that Spark reaches will do; unpack_to() makes
files of them. write_archives() makes one gzip stream of a whole archive. normalise() inflates such a stream
once, piece by piece, writes every record as a gzip member of its own and lists (record, offset, length) in
a sidecar index; read_records() opens single members by that index.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response and the
others revisit it. Defined results: a null html is an empty payload; rows with equal page_id and payload are
alike, so if theirs is the largest both are responses; a null page_id never is referred to, and without other
ids all are responses; an empty table gives no archives.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import MOST_TASKS, cut

LEAST = 1000
ARCHIVE_BYTES = 16_000_000
#: About what a record takes beside its payload and URL.
HEADER_BYTES = 320
#: Rows that are broadcast.
FEW_ROWS = 10_000
_PIECE = 1 << 18
_DATE = "1970-01-01T00:00:00Z"


def _record(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", target)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if refers is not None:
        head.append(("WARC-Refers-To", f"<urn:page:{refers}>"))
    head.append(("Content-Length", str(len(payload))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + payload + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream; no more than a record and a piece is held."""
    held, need = bytearray(), -1
    for piece in pieces:
        held += piece
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[:end]).decode()
                need = end + 4 + int(next(x for x in head.split("\r\n") if x.lower().startswith("content-length:")).split(":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("the archive ends within a record")


def inflate(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file of one member or many, in pieces."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data) and not member.unconsumed_tail:
                raise ValueError("the gzip stream ends early")
            tail = member.unconsumed_tail or data[at : at + _PIECE]
            if not member.unconsumed_tail:
                at += len(tail)
            yield member.decompress(tail, _PIECE)
        at -= len(member.unused_data)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    return rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})


def revisits(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows (page_id, digest, size and others) that revisit the row of refers; payloads aren't needed for this."""
    owners = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null").drop("n")
    return rows.where(F.col("size") >= least).join(owners, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers")))


def _write(rows: pa.Table, again: pa.Table) -> pa.Table:
    pack, out = zlib.compressobj(6, zlib.DEFLATED, 31), []
    refers = {(r["page_id"], r["digest"]): r["refers"] for r in again.to_pylist()}
    rows = rows.sort_by([("page_id", "ascending"), ("digest", "ascending")])
    for batch in rows.to_batches(max_chunksize=256):
        for r in batch.to_pylist():
            owner = refers.get((r["page_id"], r["digest"]))
            kind, payload = ("response", r["payload"]) if owner is None else ("revisit", b"")
            out.append(pack.compress(_record(kind, r["page_id"], r["url"], r["digest"], r["size"], owner, payload)))
    out.append(pack.flush())
    return pa.table({"archive": rows.column("archive").slice(0, 1), "data": pa.array([b"".join(out)], pa.binary())})


def write_archives(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, data): whole-file gzip archives of about archive_bytes before compression, one record for each page.

    Payloads are shuffled once, to their archives; which records are revisits comes there by a table of its own. Rows of
    one page_id and payload go to one archive, or where they would fill more, to any of as many as they fill.
    """
    rows = payloads(pages)
    whole = F.col("size") + HEADER_BYTES + F.coalesce(F.octet_length("url"), F.lit(0))
    meta = cut(rows.select("page_id", "digest", "size", whole.alias("bytes")))
    sums = cut(meta.groupBy("page_id", "digest").agg(F.sum("bytes").alias("bytes")))
    archives = max(1, -(-(sums.agg(F.sum("bytes")).first()[0] or 0) // archive_bytes))
    hot = cut(sums.where(F.col("bytes") > archive_bytes).select(F.col("page_id").alias("hot_id"), F.col("digest").alias("hot_digest"), F.ceil(F.col("bytes") / archive_bytes).alias("spread")))
    few = hot.count() <= FEW_ROWS

    def spread(df: DataFrame, salt: Column) -> DataFrame:
        """df with its archive; rows of a hot page_id and payload by `salt` too."""
        wide = F.broadcast(hot) if few else hot
        dealt = df.join(wide, F.col("page_id").eqNullSafe(F.col("hot_id")) & (F.col("digest") == F.col("hot_digest")), "left").withColumn("salt", salt)
        dealt = dealt.withColumn("archive", F.pmod(F.xxhash64("page_id", "digest", "salt"), F.lit(archives)).cast("long"))
        return dealt.drop("hot_id", "hot_digest", "spread", "salt")

    rows = spread(rows, F.coalesce(F.pmod(F.monotonically_increasing_id(), "spread"), F.lit(0)))
    again = revisits(meta.select("page_id", "digest", "size"), least).select("page_id", "digest", "refers").distinct()
    again = spread(again, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("spread", F.lit(1)) - 1))).distinct()
    again = again.select("archive", "page_id", "digest", "refers").toDF("archive", "page_id", "digest", "refers")
    tasks = int(min(archives, MOST_TASKS))
    dealt = (x.repartition(tasks, "archive").groupBy("archive") for x in (rows, again))
    return next(dealt).cogroup(next(dealt)).applyInArrow(_write, "archive long, data binary")


def _normalise(batches):
    for batch in batches:
        for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
            members, index, at = [], [], 0
            for record in records(inflate(data)):
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record) + pack.flush()
                index.append({"record": parse(record)[0]["WARC-Record-ID"], "offset": at, "length": len(member)})
                members.append(member)
                at += len(member)
            kind = pa.list_(pa.struct([("record", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.int64()), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)], ["archive", "data", "index"])


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, data, index): the same records, each a gzip member, and where each begins and how long it is."""
    return archives.select("archive", "data").mapInArrow(_normalise, "archive long, data binary, index array<struct<record:string,offset:long,length:long>>")


def _page(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _read(batches):
    for batch in batches:
        for data, index in zip(batch.column("data").to_pylist(), batch.column("index").to_pylist(), strict=True):
            out = []
            for entry in index:
                fields, payload = parse(zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], 31))
                out.append((_page(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], payload))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def read_records(normalised: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of every member."""
    return normalised.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def unpack_to(normalised: DataFrame, folder: str) -> None:
    """Write NNNNNN.warc.gz and its sidecar NNNNNN.idx for every archive to a folder that all executors share."""

    def write(rows):
        for r in rows:
            name = os.path.join(folder, f"{r.archive:06d}")
            for suffix, data in ((".warc.gz", r.data), (".idx", "".join(f"{e.record}\t{e.offset}\t{e.length}\n" for e in r["index"]).encode())):
                with open(f"{name}{suffix}.tmp", "wb") as f:
                    f.write(data)
                os.replace(f"{name}{suffix}.tmp", f"{name}{suffix}")

    os.makedirs(folder, exist_ok=True)
    normalised.foreachPartition(write)
