"""Queries on matrices, likelihoods, flanks and partition functions made from documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from motifloom.functions import physics
from motifloom.operators import likelihood, partition, shape, stats
from motifloom.plans import views
from motifloom.plans.registry import query, rounded
from motifloom.plans.views import site_sql, sql, table

POTENTIALS = [-1.0, -0.4, 0.5]
WIDTH, STEP, SITES = 6, 0.05, 5
_MODEL = likelihood.Model(views.ENERGIES, 0.0)

views.SQL["rounds"] = "rounds AS (SELECT doc_id AS seq_id, CAST((dense_rank() OVER (ORDER BY source NULLS FIRST) - 1) % 3 AS INTEGER) AS round FROM documents)"
views.SQL["lowest"] = f"lowest AS (SELECT seq_id, min(least(f, r)) AS e FROM (SELECT seq_id, {site_sql(views.ENERGIES)} AS f, {site_sql(physics.flipped(views.ENERGIES))} AS r FROM offsets) GROUP BY 1)"
views.SQL["words"] = f"words AS (SELECT source, substr(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 1, {WIDTH}) AS word FROM documents WHERE length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) >= {WIDTH})"
_COUNTS = ", ".join(f"sum((substr(word, CAST(pos AS INTEGER) + 1, 1) = '{b}')::INTEGER) AS n{b.lower()}" for b in "ACGT")
_ENERGY = ", ".join(f"round(-{physics.RT!r} * ln((n{b} + 1) / (greatest(na, nc, ng, nt) + 1)::DOUBLE), 3) + 0.0 AS {b}" for b in "acgt")
views.SQL["matrices"] = f"matrices AS (SELECT source, pos, {_ENERGY} FROM (SELECT source, pos, {_COUNTS} FROM words CROSS JOIN (SELECT unnest(range({WIDTH})) AS pos) GROUP BY ALL))"
views.SQL["bins"] = f"bins AS (SELECT source, pos, CAST(floor(unnest([a, c, g, t]) / {STEP} + 0.5) AS BIGINT) AS b FROM matrices)"
views.SQL["sums"] = "sums AS (SELECT b0.source, " + " + ".join(f"b{i}.b" for i in range(WIDTH)) + f" AS bin, count(*) / {4**WIDTH}.0::DOUBLE AS share FROM bins b0 " + " ".join(f"JOIN bins b{i} ON b{i}.source IS NOT DISTINCT FROM b0.source AND b{i}.pos = {i}" for i in range(1, WIDTH)) + " WHERE b0.pos = 0 GROUP BY 1, 2)"


def in_rounds(s, d):
    """The documents' sequences, each in a round by its source."""
    rank = table(s, d, "documents").select("source").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("source"))))  # of the few sources
    docs = table(s, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"), F.col("source").alias("own"))
    return docs.join(F.broadcast(rank), F.col("own").eqNullSafe(F.col("source"))).select("seq_id", "seq", ((F.col("place") - 1) % 3).cast("int").alias("round"))


def matrices(s, d):
    """A matrix for each source, from the first bases of its sequences."""
    seqs = table(s, d, "documents").select("source", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).where(F.length("seq") >= WIDTH)
    return partition.word_matrices(seqs.select("source", F.substring("seq", 1, WIDTH).alias("word")), ["source"], WIDTH, physics.RT)


def _log_occ(k: int) -> str:
    return " + ".join(f"-ln(1 + exp((e - ({mu!r})) / {physics.RT!r}))" for mu in POTENTIALS[: k + 1])


_NUMERATOR = "CASE round " + " ".join(f"WHEN {k} THEN {_log_occ(k)}" for k in range(3)) + " END"
_DENOMINATOR = "CASE round " + " ".join(f"WHEN {k} THEN (SELECT ln(sum(exp({_log_occ(k)}))) + 20 * ln(4) - ln(count(*)) FROM lowest)" for k in range(3)) + " END"


@query(sql("seqs offsets lowest rounds", f"SELECT round, n, round(numerator, 4) AS numerator, round({_DENOMINATOR}, 6) AS denominator FROM (SELECT round, count(*)::DOUBLE AS n, sum({_NUMERATOR}) AS numerator FROM lowest JOIN rounds USING (seq_id) GROUP BY 1)"))
def round_likelihoods(s, d):
    seqs = in_rounds(s, d)
    terms = likelihood.Objective(seqs, seqs, length=20, potentials=POTENTIALS).terms([_MODEL])
    return rounded(rounded(terms.select("round", "n", "numerator", "denominator"), "denominator"), "numerator", digits=4)


_SPOT = "CASE WHEN r < f THEN CASE WHEN distance < 0 THEN pos + 7 - distance ELSE pos - distance END ELSE CASE WHEN distance < 0 THEN pos + distance ELSE pos + 7 + distance END END"
views.SQL["flanks"] = f"flanks AS (SELECT distance, CASE WHEN r < f THEN translate(b, 'ACGT', 'TGCA') ELSE b END AS base, count(*) AS n FROM (SELECT distance, f, r, substr(seq, CAST(place AS INTEGER) + 1, 1) AS b FROM (SELECT *, {_SPOT} AS place FROM (SELECT seq, pos, f, r FROM (SELECT seq_id, seq, pos, {site_sql(views.ENERGIES)} AS f, {site_sql(physics.flipped(views.ENERGIES))} AS r FROM offsets) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY least(f, r), pos DESC, r < f DESC) = 1) CROSS JOIN (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS distance)) WHERE place > 0 AND place < length(seq)) GROUP BY 1, 2)"


@query(sql("seqs offsets flanks", "SELECT distance, base, n FROM flanks"))
def flank_counts(s, d):
    return likelihood.flank_counts(views.sequences(s, d), views.ENERGIES)


@query(sql("seqs offsets flanks", "SELECT distance, CAST(n AS BIGINT) AS n, round(-(" + " + ".join(f"({b} + 1) / (n + 4) * ln(({b} + 1) / (n + 4) + 1e-6)" for b in "acgt") + "), 6) AS entropy FROM (SELECT distance, sum(n) AS n, " + ", ".join(f"coalesce(sum(n) FILTER (base = '{b.upper()}'), 0) AS {b}" for b in "acgt") + " FROM flanks GROUP BY 1)"))
def flank_entropies(s, d):
    return rounded(likelihood.flank_entropies(likelihood.flank_counts(views.sequences(s, d), views.ENERGIES)), "entropy")


@query(sql("words matrices", "SELECT source, CAST(pos AS INTEGER) AS pos, a, c, g, t FROM matrices"))
def source_matrices(s, d):
    return matrices(s, d)


@query(sql("words matrices bins sums", f"SELECT source, round(bin * {STEP}::DOUBLE, 4) AS energy, round(share, 9) AS share FROM sums"))
def word_partition(s, d):
    found = partition.partition_functions(matrices(s, d), ["source"], step=STEP, method="polynomials")
    return rounded(rounded(found, "energy", digits=4), "share", digits=9)


@query(sql("words matrices bins sums", f", below AS (SELECT source, bin, 1 - (1 - least(sum(share) OVER (PARTITION BY source ORDER BY bin), 1.0)) ** {SITES} AS c FROM sums), lowest AS (SELECT source, bin, c - coalesce(lag(c) OVER (PARTITION BY source ORDER BY bin), 0) AS share FROM below) SELECT source, round(sum(share / (1 + exp((bin * {STEP}::DOUBLE - 0.7) / {physics.RT!r}))) / sum(share), 6) AS occupancy FROM lowest GROUP BY 1"))
def lowest_site_occupancy(s, d):
    found = partition.partition_functions(matrices(s, d), ["source"], step=STEP, sites=SITES, method="fft")
    return rounded(partition.mean_occupancies(found, ["source"], 0.7), "occupancy")


_PRODUCT = [" * ".join(f"1 / (1 + exp((bin * {STEP}::DOUBLE - ({mu!r})) / {physics.RT!r}))" for mu in POTENTIALS[: k + 1]) for k in range(3)]


@query(sql("words matrices bins sums", "SELECT source, round, round(log_sum, 6) AS log_sum FROM (" + " UNION ALL ".join(f"SELECT source, {k}::BIGINT AS round, ln(sum(share * {_PRODUCT[k]})) + 12 * ln(4) AS log_sum FROM sums GROUP BY 1" for k in range(3)) + ")"))
def partition_denominators(s, d):
    found = partition.partition_functions(matrices(s, d), ["source"], step=STEP, method="fft")
    return rounded(partition.denominators(found, ["source"], POTENTIALS, 12), "log_sum")


# -- shapes ------------------------------------------------------------------------------------------------------------

FEATURES = ["strong", "share"]
DIFFERENCES = np.round(np.diff(views.ENERGIES[:, :], axis=1).cumsum(1).T, 6)
SHAPE = np.array([[0.2, -0.1, 0.0, 0.3, -0.2, 0.1, 0.05, -0.05], [3.0, 0.0, -2.0, 1.0, 0.5, 0.0, -1.0, 2.0]])

views.SQL["fives"] = "fives AS (SELECT word, (length(word) - length(replace(replace(word, 'C', ''), 'G', '')))::DOUBLE AS strong, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS share FROM (SELECT substr(seq, CAST(i AS INTEGER) + 1, 5) AS word FROM (SELECT seq, unnest(range(length(seq) - 4)) AS i FROM seqs WHERE length(seq) >= 5)) GROUP BY 1)"


def words_of_five(s, d):
    """Features of the words of five bases, from the documents: how many of them are C or G, and the word's share."""
    counts = stats.kmer_counts(views.sequences(s, d), 5, both_strands=False)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # of 1024 rows
    strong = F.length(F.regexp_replace("kmer", "[AT]", "")).cast("double")
    return counts.select(F.col("kmer").alias("word"), strong.alias("strong"), F.round(F.col("n") / total, 9).alias("share"))


@query(sql("seqs fives", "SELECT seq_id, round(sum(f.strong), 6) AS strong_fwd, round(sum(f.share), 6) AS share_fwd, round(sum(coalesce(r.strong, 0)), 6) AS strong_rc, round(sum(coalesce(r.share, 0)), 6) AS share_rc FROM (SELECT seq_id, substr(seq, CAST(i AS INTEGER) + 1, 5) AS word FROM (SELECT seq_id, seq, unnest(range(length(seq) - 4)) AS i FROM seqs WHERE length(seq) >= 5)) w JOIN fives f USING (word) LEFT JOIN fives r ON r.word = translate(reverse(w.word), 'ACGT', 'TGCA') GROUP BY 1"))
def shape_sums(s, d):
    sums = shape.shape_sums(views.sequences(s, d).where("length(seq) >= 5"), words_of_five(s, d), FEATURES)
    return rounded(sums, *(f"{f}_{k}" for f in FEATURES for k in ("fwd", "rc")))


@query(sql("seqs offsets", f"SELECT seq_id, round(min(least(f, r)) - ({float(views.ENERGIES[:, 0].sum())!r}), 6) AS energy FROM (SELECT seq_id, {site_sql(views.ENERGIES)} AS f, {site_sql(physics.flipped(views.ENERGIES))} AS r FROM offsets) GROUP BY 1"))
def difference_energies(s, d):
    return rounded(shape.affinities(views.sequences(s, d).where("length(seq) >= 8"), DIFFERENCES), "energy")


@query("SELECT vec_id, round(sum(abs(x)), 5) AS absolute, round(sum((abs(x) - x) / 2), 5) AS negative, round(ln(1 + sum(abs(x))), 6) AS log_absolute FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def penalties(s, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(s, d, "embeddings").select("vec_id", physics.absolute_penalty(x).alias("absolute"), physics.negative_penalty(x).alias("negative"), physics.log_abs_penalty(x).alias("log_absolute"))
    return rounded(rounded(rows, "log_absolute"), "absolute", "negative", digits=5)
