"""Lines of split files by their place, and genomes of chunks from FASTA files (S2, S3, S4, J19 of the survey).

A file is read in splits.  A first pass sums up each split in one row; with the sums of the splits before it, each split
then knows where its first line stands, so lines are numbered, and bases placed in their records, where they are read.
Compressed files are one split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.operators.scratch import written


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block) of every line; ``block`` is where the line's split begins."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def numbered_lines(spark: SparkSession, path: str | list[str], *, across: bool = False) -> DataFrame:
    """(file, line, value): every line with its number in its file, or in all files in the order of their names, from 0.

    Lines of a split have successive numbers of rows, so a line's number is that of its row less the split's first, and
    the lines of the splits before."""
    rows = lines(spark, path).withColumn("row", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("file", "block") if across else Window.partitionBy("file").orderBy("block")
    before = F.sum("n").over(order) - F.col("n")  # a row for each split
    splits = written(splits.select("file", "block", (before - F.col("first")).alias("shift")), "splits")
    return rows.join(splits, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "value")


def zipped_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(line, left, right) of two files, or folders of files in the order of their names, as far as both go."""
    one, other = (numbered_lines(spark, p, across=True).select("line", F.col("value").alias(name)) for p, name in ((left, "left"), (right, "right")))
    return one.join(other, "line")


class Records:
    """The bases of a FASTA file's splits: summed up, or placed in their records."""

    def __init__(self, chunk: int, starts=None) -> None:
        self.chunk, self.starts = chunk, starts

    @staticmethod
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
        """Lines of one split, in order; a split may come in several runs."""
        for batch in batches:
            file, block = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            border = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            for s, e in zip([0, *border.tolist()], [*border.tolist(), batch.num_rows]):
                if e > s:
                    yield (int(file[s]), int(block[s])), batch.column(0).slice(s, e - s).to_pylist()

    def summed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each split the bases before its first header, its last header and the bases after that."""
        sums: dict[tuple[int, int], list] = {}
        for split, texts in self.runs(batches):
            own = sums.setdefault(split, [0, None, 0])
            for text in texts:
                if text.startswith(">"):
                    own[1], own[2] = text, 0
                else:
                    own[0 if own[1] is None else 2] += len("".join(text.split()))
        if sums:
            keys, values = zip(*sums), zip(*sums.values())
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), *(pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.string(), pa.int64())))], names=["file", "block", "head", "last", "tail"])

    def placed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces (contig, chunk, at, piece) of the chunks of each record; about one for a chunk and split."""
        rows: list[tuple[str, int, int, str]] = []
        split, contig, at, held = None, None, 0, []

        def put(final: bool) -> None:
            """Cuts the bases held at the chunks' borders; but for the last, only whole chunks."""
            nonlocal at, held
            bases, done = "".join(held), 0
            while done < len(bases):
                room = self.chunk - at % self.chunk
                if not final and len(bases) - done < room:
                    break
                rows.append((contig, at // self.chunk, at % self.chunk, bases[done : done + room]))
                taken = min(room, len(bases) - done)
                done, at = done + taken, at + taken
            held = [bases[done:]] if done < len(bases) else []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["contig", "chunk", "at", "piece"])
            rows = []

        size = 0
        for own, texts in self.runs(batches):
            if own != split:
                if contig is not None:
                    put(True)
                split, (contig, at), held = own, self.starts.value[own], []
            for text in texts:
                if text.startswith(">"):
                    if contig is not None:
                        put(True)
                    contig, at, held, size = text, 0, [], 0
                elif contig is not None and text:
                    held.append("".join(text.split()))
                    size += len(held[-1])
                    if size >= 4 * self.chunk:
                        put(False)
                        size = 0
            yield from out()
        if contig is not None:
            put(True)
        yield from out()


def genome(spark: SparkSession, path: str | list[str], *, chunk: int = 1 << 16) -> DataFrame:
    """(contig, chunk, seq) of FASTA files with any number of lines a record: chunks of equal length of each
    record, ``contig`` being the first word of its header.  No value is longer than a line or a chunk.

    Bases before a file's first header belong to no record.  Two records of one name must not stand in the files."""
    rows = lines(spark, path).select("value", F.xxhash64("file").alias("file"), "block")
    splits = rows.mapInArrow(Records(chunk).summed, "file long, block long, head long, last string, tail long").groupBy("file", "block").agg(F.max("head").alias("head"), F.max("last").alias("last"), F.max("tail").alias("tail"))
    starts: dict[tuple[int, int], tuple[str | None, int]] = {}
    file, contig, at = None, None, 0
    for r in splits.orderBy("file", "block").toLocalIterator():  # a row for each split
        if r["file"] != file:
            file, contig, at = r["file"], None, 0
        starts[(r["file"], r["block"])] = (contig, at)
        contig, at = (contig, at + r["head"]) if r["last"] is None else (r["last"], r["tail"])
    place = Records(chunk, spark.sparkContext.broadcast(starts))
    pieces = rows.mapInArrow(place.placed, "contig string, chunk long, at int, piece string")
    name = F.regexp_extract("contig", r"^>\s*(\S*)", 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(name.alias("contig"), "chunk").agg(joined.alias("seq"))
