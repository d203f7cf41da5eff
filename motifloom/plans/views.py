"""Genomic views over the driver's tables, once as Spark plans and once as DuckDB common table expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.operators.intervals import centred

#: An invented motif of eight positions about CACGTG: shares of A, C, G, T.
SHARES = np.array([[0.30, 0.20, 0.40, 0.10], [0.05, 0.85, 0.05, 0.05], [0.90, 0.04, 0.03, 0.03], [0.03, 0.90, 0.04, 0.03], [0.03, 0.04, 0.90, 0.03], [0.03, 0.03, 0.04, 0.90], [0.05, 0.05, 0.85, 0.05], [0.10, 0.40, 0.20, 0.30]])
WEIGHTS = np.round(np.log2(np.maximum(SHARES, 1e-4)), 6)
ENERGIES = np.round(-0.5961 * np.log(SHARES / SHARES.max(1, keepdims=True)), 6)
HALF_WIDTH = 250


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.concat(F.lit("chr"), F.col("user_id") % 22 + 1).alias("contig"), F.floor(seconds / 10).cast("long").alias("start"), (200 + F.col("event_id") % 800).alias("w"))


def accessible(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where("event_type = 'view'")
    return e.select(F.col("event_id").alias("row_id"), F.concat(F.lit("E"), 114 + F.col("user_id") % 5).alias("sample_id"), "contig", "start", (F.col("start") + F.col("w")).alias("stop"), (F.col("event_id") * 7 % F.col("w")).alias("summit"), F.col("value").alias("signal_value"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return centred(accessible(spark, sf), HALF_WIDTH)


def observed(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where("event_type in ('purchase', 'signup')")
    return e.select(F.col("event_id").alias("id"), "contig", "start", (F.col("start") + F.col("w")).alias("stop"), F.col("value").alias("score"), F.when(F.col("event_type") == "purchase", "optimal").otherwise("relaxed").alias("pk_type"), F.concat(F.lit("T"), F.col("event_id") % 4).alias("tf_id"), F.concat(F.lit("E"), 114 + F.col("user_id") % 5).alias("sample_id"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))


def track(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where("event_type = 'click'")
    return e.select("contig", F.col("start").alias("pos"), (F.col("start") + 36).alias("aend"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))


#: The same in DuckDB; a query lists the expressions that it needs.
SQL = {
    "ev": "ev AS (SELECT event_id, user_id, event_type, value, 'chr' || (user_id % 22 + 1) AS contig, CAST(floor(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 10) AS BIGINT) AS start, 200 + event_id % 800 AS w FROM events)",
    "acc": "acc AS (SELECT event_id AS row_id, 'E' || (114 + user_id % 5) AS sample_id, contig, start, start + w AS stop, (event_id * 7) % w AS summit, value AS signal_value FROM ev WHERE event_type = 'view')",
    "cen": "cen AS (SELECT row_id, sample_id, contig, start + summit - 250 AS start, start + summit + 250 AS stop, CAST(250 AS BIGINT) AS summit, signal_value FROM acc WHERE start + summit - 250 > 0)",
    "chip": "chip AS (SELECT event_id AS id, contig, start, start + w AS stop, value AS score, CASE WHEN event_type = 'purchase' THEN 'optimal' ELSE 'relaxed' END AS pk_type, 'T' || (event_id % 4) AS tf_id, 'E' || (114 + user_id % 5) AS sample_id FROM ev WHERE event_type IN ('purchase', 'signup'))",
    "pairs": "pairs AS (SELECT c.row_id, p.id, p.pk_type, p.tf_id, p.score, (least(c.stop, p.stop) - greatest(c.start, p.start)) / (p.stop - p.start)::DOUBLE AS fraction FROM cen c JOIN chip p ON c.contig = p.contig AND c.start < p.stop AND p.start < c.stop)",
    "best": "best AS (SELECT row_id, pk_type, fraction, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id, pk_type ORDER BY fraction DESC, id) AS i FROM pairs) WHERE i = 1)",
    "labelled": "labelled AS (SELECT c.row_id, c.sample_id, c.contig, c.signal_value, coalesce(o.fraction > 0.5, false) AS o, coalesce(r.fraction > 0.5, false) AS r, CASE WHEN o.fraction > 0.5 THEN o.score ELSE 0 END AS so, CASE WHEN r.fraction > 0.5 THEN r.score ELSE 0 END AS sr FROM cen c LEFT JOIN best o ON o.row_id = c.row_id AND o.pk_type = 'optimal' LEFT JOIN best r ON r.row_id = c.row_id AND r.pk_type = 'relaxed')",
    "final": "final AS (SELECT row_id, sample_id, contig, signal_value, CASE WHEN o THEN 1 WHEN r THEN -1 ELSE 0 END AS label, CASE WHEN NOT o AND r THEN greatest(so, sr) ELSE so END AS score FROM labelled)",
    "seqs": "seqs AS (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)",
    "scored": "scored AS (SELECT l.doc_id, d.lang, l.quality AS label, d.n_chars::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))",
    "track": "track AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "reads": "reads AS (SELECT contig, start AS pos, start + 36 AS aend, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM ev WHERE event_type = 'click')",
    "offsets": "offsets AS (SELECT seq_id, seq, unnest(range(length(seq) - 7)) AS pos FROM seqs WHERE length(seq) >= 8)",
}


def sql(names: str, body: str) -> str:
    """A statement with the named expressions before its body."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + (body if body.startswith(",") else " " + body)


def site_sql(matrix: np.ndarray) -> str:
    """The sum of a matrix over the bases from ``pos``."""
    return " + ".join(f"CASE substr(seq, CAST(pos AS INTEGER) + {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {row['ACGT'.index(b)]!r}::DOUBLE" for b in "ACGT") + " END" for i, row in enumerate(np.asarray(matrix).tolist()))
