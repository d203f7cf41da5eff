"""Queries that write the given tables in the engine's formats and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motifloom.operators.scratch import folder
from motifloom.plans import views
from motifloom.plans.registry import query, rounded
from motifloom.plans.views import sql
from motifloom.sources import genome, indexed, readers, writers


def _place(s: SparkSession, name: str) -> str:
    return f"{folder(s)}/{name}-{uuid.uuid4().hex}"


@query(sql("ev acc", "SELECT contig, start, stop, sample_id AS name, summit::DOUBLE AS score FROM acc"))
def bed_files(s, d):
    path = _place(s, "bed")
    writers.bed(views.accessible(s, d).select("contig", "start", "stop", "sample_id", "summit"), path, ("contig", "start", "stop", "sample_id", "summit"))
    return readers.bed(s, path)


@query(sql("ev acc", "SELECT contig, start, stop, summit, signal_value FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS i FROM acc) WHERE i <= 200"))
def first_peaks(s, d):
    """The first peaks of files that hold them in order."""
    path = _place(s, "peaks")
    rows = views.accessible(s, d).repartitionByRange("row_id").sortWithinPartitions("row_id")
    line = F.concat_ws("\t", "contig", "start", "stop", F.lit("."), F.lit("0"), F.lit("."), "signal_value", F.lit("-1"), F.lit("-1"), "summit")
    rows.select(line.alias("value")).write.text(path)
    return readers.narrow_peak(s, path, limit=200).select("contig", "start", "stop", "summit", "signal_value")


@query(sql("seqs", "SELECT CAST(seq_id AS VARCHAR) AS contig, CAST(i // 256 AS BIGINT) AS chunk, substr(seq, CAST(i + 1 AS INTEGER), 256) AS seq FROM (SELECT seq_id, seq, unnest(range(0, length(seq), 256)) AS i FROM seqs WHERE length(seq) > 0)"))
def genome_chunks(s, d):
    """A genome from FASTA files of sixty bases a line."""
    path = _place(s, "genome")
    seqs = views.sequences(s, d).where("length(seq) > 0")
    writers.fasta(seqs.withColumn("seq", F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")), path, "seq_id")
    return genome.genome(s, path, chunk=256)


@query(sql("seqs", "SELECT '>' || seq_id AS contig, CAST(length(seq) AS BIGINT) AS stop, seq FROM seqs WHERE length(seq) > 0"))
def fasta_records(s, d):
    path = _place(s, "fasta")
    writers.fasta(views.sequences(s, d).where("length(seq) > 0"), path, "seq_id")
    return readers.fasta(s, path).select("contig", "stop", "seq")


@query(sql("seqs", "SELECT seq, count(*) AS n FROM seqs WHERE length(seq) > 0 GROUP BY 1"))
def fastq_reads(s, d):
    path = _place(s, "fastq")
    writers.fastq(views.sequences(s, d).where("length(seq) > 0"), path)
    return readers.fastq(s, path).groupBy("seq").agg(F.count("*").alias("n"))


@query(sql("ev acc", "SELECT row_id, sample_id, contig, start, signal_value FROM acc"))
def feature_files(s, d):
    path = _place(s, "features")
    columns = "row_id long, sample_id string, contig string, start long, signal_value double"
    writers.features(views.accessible(s, d).select("row_id", "sample_id", "contig", "start", "signal_value"), path)
    return readers.table(s, path, schema=columns)


@query(sql("track", "SELECT 'chr' || (vec_id % 5) AS contig, CAST(vec_id * 64 + pos AS BIGINT) AS pos, round(v, 6) AS value FROM track WHERE vec_id % 5 = 3 AND vec_id * 64 + pos >= 1000 AND vec_id * 64 + pos < 20000"))
def track_slices(s, d):
    """Scores stored by contig, and a slice of one."""
    path = _place(s, "scores")
    rows = views.track(s, d).select(F.concat(F.lit("chr"), F.col("vec_id") % 5).alias("contig"), (F.col("vec_id") * 64 + F.col("pos")).alias("pos"), F.col("v").alias("value"))
    writers.scores(rows, path)
    return rounded(readers.tracks(s, path, "chr3", 1000, 20_000).select("contig", "pos", "value"), "value")


@query(sql("track", "SELECT 'chr' || (vec_id % 5) AS contig, CAST(vec_id * 64 + pos AS BIGINT) AS start, CAST(vec_id * 64 + pos + 1 AS BIGINT) AS stop, round(v, 6) AS score FROM track"))
def score_lines(s, d):
    path = _place(s, "lines")
    rows = views.track(s, d).select(F.concat(F.lit("chr"), F.col("vec_id") % 5).alias("contig"), (F.col("vec_id") * 64 + F.col("pos")).alias("pos"), F.col("v").alias("score"))
    writers.bed_graph(rows, path)
    return rounded(s.read.option("sep", "\t").schema("contig string, start long, stop long, score double").csv(path), "score")


@query(sql("ev acc", "SELECT row_id, contig, start, stop FROM acc WHERE contig = 'chr3' AND start < 60000 AND stop > 20000"))
def region_of_files(s, d):
    path = _place(s, "indexed")
    indexed.write_indexed(views.accessible(s, d).select("row_id", "contig", "start", "stop"), path, rows=500)
    return indexed.read_region(s, path, "chr3", 20_000, 60_000)


@query(sql("ev", "SELECT user_id AS row_id, " + ", ".join(f"max(event_id) FILTER (event_type = '{t}') AS {t}" for t in ("click", "purchase", "signup", "view")) + " FROM ev GROUP BY 1"))
def matrix_files(s, d):
    """A matrix and the names beside it, by which its columns are chosen."""
    path = _place(s, "matrix")
    rows = views.events(s, d).select(F.col("user_id").alias("row_id"), "event_type", "event_id")
    writers.matrix(rows, path, "row_id", "event_type", "event_id", ["view", "click", "signup", "purchase"])
    names = [r["value"] for r in s.read.text(f"{path}.tfnames").collect()]
    return s.read.parquet(path).select("row_id", *names)


@query(sql("ev", "SELECT i AS line, l AS left, r AS right FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, event_type AS l, contig AS r FROM ev)"))
def zipped_files(s, d):
    """Predictions and labels from two folders of files, by line."""
    left, right = _place(s, "left"), _place(s, "right")
    rows = views.events(s, d).select("event_id", "event_type", "contig")
    for n, column, path in ((5, "event_type", left), (3, "contig", right)):  # files of other lengths on either side
        rows.repartitionByRange(n, "event_id").sortWithinPartitions("event_id").select(F.col(column).alias("value")).write.text(path)
    return genome.zipped_lines(s, left, right)
