"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by page id and digest over shards.  A shard's border follows from the running byte count in that
order, which is summed on the executors (range-sorted parts, plus the parts before), so equal input gives equal files
however it is partitioned; the driver holds one key for each shard.  Within a shard a file is closed once it has
``roll_bytes`` of compressed data.  Headers and digests are made anew; each record is a gzip member of its own without a
time.  Files are written under temporary names that no two task attempts share, renamed by tasks when all have been
written, and listed in a manifest that is written last; a reader sees only what the manifest names.  A lost executor's
tasks simply write again under other names, and a rename that was done before is not done again.

Of records of equal payload (of ``min_dedup_bytes`` at least) that with the largest page id is a response, the others
are revisits that refer to it.  Null payloads count as empty.  Rows that repeat a page id with an equal payload have
the same record type and stand in the order of their URLs.  Null ids are never referred to and sort first; null URLs
give records without a target URI.  Very long payloads are one record each, held by one task.  An empty table gives an
empty manifest and no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.llm.shared import folder, written

RECORD_BYTES = 512  # of a record's headers, about
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_SCHEMA = "shard long, part long, temporary string, path string, records long, bytes long, sha256 string"


def resolved(spark: SparkSession, folder_uri: str) -> str:
    """The folder made, by an address that tasks can open: that of the store behind a view, and s3 for s3a."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder_uri)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    return re.sub("^s3[an]:", "s3:", fs.resolvePath(place).toString())


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors reach, and the folder's path there."""
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page_id}:{digest}')}>"


def record(row: dict, date: str) -> bytes:
    """One record as a gzip member."""
    payload = row["payload"]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = row["refers_to"] is not None
    block = b"" if revisit else payload
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row["page_id"], digest)), ("WARC-Date", date)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"])))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{block_digest}"), ("X-Payload-Length", str(len(payload)))]
    if row["page_id"] is not None:
        fields.append(("X-Page-Id", str(row["page_id"])))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], digest)), ("X-Refers-To-Page", str(row["refers_to"]))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without name and time
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def borders(slim: DataFrame, shard_bytes: int) -> list[tuple[int, str]]:
    """The first (id, digest) of each shard but the first, of rows (at, digest, payload_bytes): a shard begins with the
    row before which the bytes so far reach another multiple of ``shard_bytes``.  As many as there are shards."""
    ranged = slim.repartitionByRange("at", "digest").select(F.spark_partition_id().alias("part"), "at", "digest", (F.col("payload_bytes") + RECORD_BYTES).alias("b"))
    ranged = written(ranged, "ranges")
    sums = ranged.groupBy("part").agg(F.sum("b").alias("b"))  # a row for each partition
    before = sums.select("part", (F.sum("b").over(Window.orderBy("part")) - F.col("b")).alias("before"))
    own = F.sum("b").over(Window.partitionBy("part").orderBy("at", "digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")
    placed = ranged.withColumn("own", own).join(F.broadcast(before), "part")
    shard = F.floor((F.col("before") + F.col("own")) / F.lit(shard_bytes))
    first = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("at", "digest")).alias("x")).where("shard > 0").select("x.at", "x.digest").distinct()
    return sorted((r["at"], r["digest"]) for r in first.collect())


def shard_of(keys: list[tuple[int, str]]):
    """A function of (at, digest): how many borders are not above a row."""
    ids, digests = np.array([k for k, _ in keys], np.int64), [d for _, d in keys]

    @F.pandas_udf("long")
    def number(at: pd.Series, digest: pd.Series) -> pd.Series:
        own = at.to_numpy()
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(low < high):  # rows of an id in which a shard begins
            high[i] = bisect.bisect_right(digests, digest.iloc[i], low[i], high[i])
        return pd.Series(high)

    return number


def write(pages: DataFrame, out: str, *, shard_bytes: int | None = None, roll_bytes: int = 256 << 20, min_dedup_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", few: int = 100_000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Writes the archives of all rows to the folder ``out``; returns the manifest's place.

    ``shard_bytes``: of payload in a shard; by default a 64th of the whole, between 1 MB and 1 GB."""
    spark = pages.sparkSession
    out = resolved(spark, out)
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    at = F.coalesce("page_id", F.lit(-(1 << 63)))
    slim = written(rows.select("page_id", at.alias("at"), "digest", "payload_bytes"), "records")
    if shard_bytes is None:
        shard_bytes = min(1 << 30, max(1 << 20, (slim.agg(F.sum("payload_bytes")).first()[0] or 0) // 64))
    keys = borders(slim, shard_bytes)

    groups = slim.where(F.col("payload_bytes") >= min_dedup_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    groups = written(groups.where("n > 1 and first is not null").select("digest", "first"), "groups")
    hinted = F.broadcast(groups) if groups.count() <= few else groups  # some 6 MB; beyond that both sides are shuffled
    refers = F.when((F.col("first") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first"))
    full = rows.join(hinted, "digest", "left").withColumns({"refers_to": refers, "shard": shard_of(keys)(at, "digest") if keys else F.lit(0).cast("long")})
    full = full.select("shard", "page_id", "url", "payload", "refers_to", "digest")
    ordered = full.repartition(max(1, min(len(keys) + 1, 100_000)), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "url").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(out)
        attempt = uuid.uuid4().hex
        place = f"{top}/_temporary/{attempt}"
        current: dict | None = None

        def begin(shard: int, part: int) -> dict:
            fs.create_dir(place, recursive=True)
            name = f"shard-{shard:08d}-{part:05d}.warc.gz"
            return {"shard": shard, "part": part, "temporary": f"_temporary/{attempt}/{name}", "path": name, "records": 0, "bytes": 0, "sha": hashlib.sha256(), "file": fs.open_output_stream(f"{place}/{name}", compression=None)}

        def end(x: dict) -> pa.RecordBatch:
            x.pop("file").close()
            x["sha256"] = x.pop("sha").hexdigest()
            return pa.RecordBatch.from_pylist([x], schema=manifest)

        manifest = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("temporary", pa.string()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if current and (current["shard"] != row["shard"] or current["bytes"] >= roll_bytes):
                        part = current["part"] + 1 if current["shard"] == row["shard"] else 0
                        yield end(current)
                        current = begin(row["shard"], part)
                    current = current or begin(row["shard"], 0)
                    raw = record(row, date)
                    current["file"].write(raw)
                    current["sha"].update(raw)
                    current["bytes"] += len(raw)
                    current["records"] += 1
        if current:
            yield end(current)

    return commit(written(ordered.mapInArrow(run, MANIFEST_SCHEMA), "manifest"), out)


def commit(made: DataFrame, out: str) -> str:
    """Renames the files of the attempts that succeeded, drops all others, and writes the manifest: one line a file."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(out)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{top}/{row['temporary']}").type != pafs.FileType.NotFound:  # else an attempt before did it
                    fs.move(f"{top}/{row['temporary']}", f"{top}/{row['path']}")
            yield batch

    fs, top = opened(out)
    lines = [{k: r[k] for k in ("shard", "part", "path", "records", "bytes", "sha256")} for r in written(made.mapInArrow(rename, MANIFEST_SCHEMA), "manifest").orderBy("shard", "part").toLocalIterator()]
    if fs.get_file_info(f"{top}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{top}/_temporary")
    with fs.open_output_stream(f"{top}/manifest.tmp", compression=None) as f:
        f.write("".join(json.dumps(x) + "\n" for x in lines).encode())
    fs.move(f"{top}/manifest.tmp", f"{top}/manifest.json")
    return f"{out}/manifest.json"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each gzip member of a stream."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("a record ends early")
                return
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        raw = b"".join(parts)
        head, _, body = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])]


def read(df_session, manifest: str) -> DataFrame:
    """``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``block`` of all
    records; digests of blocks are checked."""
    out = resolved(df_session, manifest.rsplit("/", 1)[0])
    files = df_session.read.schema("path string, bytes long").json(manifest)
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(out)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{top}/{path}", compression=None) as f:
                    rows, size = [], 0
                    for h, block in records(f):
                        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        if h["WARC-Block-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{path}: a block does not have its digest")
                        response = h["WARC-Type"] != "revisit"
                        rows.append({"page_id": number(h.get("X-Page-Id")), "url": h.get("WARC-Target-URI"), "payload_bytes": len(block) if response else int(h["X-Payload-Length"]), "payload_digest": digest if response else h["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page")), "block": block})
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path").repartition(min(n, 100_000)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary")


def round_trip(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Writes all rows and reads the archives back."""
    spark = pages.sparkSession
    out = out or f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    return read(spark, write(pages, out, **options))
