"""Sequence enrichment: simulation and fits (R4, R8, R9, L1 to L7, C4, C5 of the survey).

Sequences stay in Spark; the driver holds matrices of a motif's size.  Each round of a fit is one aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.functions.physics import RT, root
from motifloom.functions.sequence import random_sequence
from motifloom.operators.motif import best_site, scan
from motifloom.operators.sampling import draw, resampled
from motifloom.operators.stats import consensus_kmer, kmer_counts, position_counts


def pool(spark, n: int, length: int, seed: int = 0) -> DataFrame:
    """n random sequences (seq_id, seq)."""
    return spark.range(n).select(F.col("id").alias("seq_id"), random_sequence(F.col("id"), length, seed).alias("seq"))


def energies(seqs: DataFrame, ddg: np.ndarray, consensus: float = 0.0) -> DataFrame:
    """the lowest energy over sites and strands of every sequence (seq_id, seq, energy); an error for a sequence that
    is shorter than the matrix."""
    short = F.raise_error(F.concat(F.lit("shorter than the motif: "), F.col("seq")))
    sites = scan(seqs.select("seq_id", F.when(F.length("seq") >= len(ddg), F.col("seq")).otherwise(short.cast("string")).alias("seq")), ddg, lowest=True)
    best = sites.groupBy("seq_id").agg((F.min("site_score") + consensus).alias("energy"))
    return seqs.select("seq_id", "seq").join(best, "seq_id")  # the sequence itself does not go through the scan's shuffle


def chemical_potential(scored: DataFrame, protein: float, dna: float) -> float:
    """L1: mu at which free and bound protein add up; by bisection over a histogram of energies (a few hundred bins)."""
    bins = [(r["e"], r["n"]) for r in scored.groupBy(F.round("energy", 2).alias("e")).agg(F.count("*").alias("n")).collect()]
    e, n = np.array([b[0] for b in bins], float), np.array([b[1] for b in bins], float)

    def excess(mu: float) -> float:
        return np.exp(mu / RT) + dna * np.sum(n / (1 + np.exp((e - mu) / RT))) / n.sum() - protein

    return root(excess, -40.0, 5.0)


def simulate(spark, ddg: np.ndarray, *, n_pool: int, sizes: list[int], length: int = 20, protein: float = 7.75e-10, dna: float = 2e-8, seed: int = 0) -> list[DataFrame]:
    """(seq_id, seq) read in each round; the pool of a round is drawn in proportion to occupancy."""
    current, out = pool(spark, n_pool, length, seed), []
    for i, size in enumerate(sizes):
        scored = energies(current, ddg)
        mu = chemical_potential(scored, protein, dna)
        weighted = scored.withColumn("w", 1 / (1 + F.exp((F.col("energy") - mu) / RT)))
        drawn = resampled(weighted, "seq_id", "w", n_pool, seed + i + 1)
        current = drawn.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select((F.col("seq_id") * n_pool + F.col("_c")).alias("seq_id"), "seq")
        out.append(current.orderBy(draw(F.col("seq_id"), seed), "seq_id").limit(size))
    return out


def log_likelihood(seqs: DataFrame, background: DataFrame, ddg: np.ndarray, mu: float) -> float:
    """L2: log occupancies of the sequences less as often the log of the background's mean occupancy."""
    def term(df: DataFrame):
        return energies(df, ddg).withColumn("lo", -F.log1p(F.exp((F.col("energy") - mu) / RT)))
    own = term(seqs).agg(F.sum("lo"), F.count("*")).first()
    mean = term(background).agg(F.avg(F.exp("lo"))).first()[0]
    return own[0] - own[1] * float(np.log(mean))


def initial_matrix(seqs: DataFrame, length: int, shrink: float = 0.25) -> np.ndarray:
    """Shares from the most frequent word: its bases, and equal parts of ``shrink``."""
    word = consensus_kmer(kmer_counts(seqs, length)).first()["kmer"]
    p = np.full((length, 4), shrink / 4)
    for i, b in enumerate(word):
        p[i, "ACGT".index(b)] += 1 - shrink
    return p


def align(seqs: DataFrame, length: int, rounds: int = 50) -> np.ndarray:
    """Hard assignment of each sequence to its best site and the counts by position, until nothing changes."""
    p = initial_matrix(seqs, length)
    for _ in range(rounds):
        best = best_site(scan(seqs.select("seq_id", "seq"), np.log2(p)).select("seq_id", "seq", "offset", "is_rc", "site_score"), ["seq_id", "seq"])
        word = F.substr("seq", F.col("offset") + 1, F.lit(length))
        site = F.when(F.col("is_rc"), F.translate(F.reverse(word), "ACGT", "TGCA")).otherwise(word)
        counts = position_counts(best.select(site.alias("site")), length).collect()  # 4 * length rows
        new = np.full((length, 4), 1.0)
        for r in counts:
            new[r["pos"], "ACGT".index(r["base"])] += r["n"]
        new /= new.sum(1, keepdims=True)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def gradient(seqs: DataFrame, background: DataFrame, ddg: np.ndarray, mu: float) -> np.ndarray:
    """L2: of the mean log-likelihood by the entries of the matrix: bases at the best sites, weighted by how far the
    occupancy of the site responds, of the background less of the sequences."""
    n = len(ddg)

    def counts(df: DataFrame, weight) -> tuple[np.ndarray, float]:
        best = best_site(scan(df.select("seq_id", "seq"), ddg, lowest=True), ["seq_id"], lowest=True).join(df.select("seq_id", "seq"), "seq_id")
        word = F.substr("seq", F.col("offset") + 1, F.lit(n))
        rows = best.select(F.when(F.col("is_rc"), F.translate(F.reverse(word), "ACGT", "TGCA")).otherwise(word).alias("site"), (1 / (1 + F.exp((F.col("site_score") - mu) / RT))).alias("occ"))
        out = np.zeros((n, 4))
        for r in position_counts(rows, n, weight=weight).collect():  # 4 * n rows
            out[r["pos"], "ACGT".index(r["base"])] = r["n"]
        return out, rows.agg(F.sum("occ")).first()[0]

    occ = F.col("occ")
    own, _ = counts(seqs, 1 - occ)
    back, total = counts(background, occ * (1 - occ))
    return (back / total - own / seqs.count()) / RT


def fit(seqs: DataFrame, background: DataFrame, length: int, *, protein: float = 7.75e-10, dna: float = 2e-8, rounds: int = 20, rate: float = 0.1, patience: int = 5) -> tuple[np.ndarray, list[float]]:
    """L3, L4, C4: an energy matrix that the sequences are likeliest under, by Adam steps on the gradient; the matrix
    of the best round and the likelihoods.  Stops after ``patience`` rounds without a better one."""
    p = align(seqs, length)
    ddg = -RT * np.log(p / p.max(1, keepdims=True))
    first, second, best, history = np.zeros_like(ddg), np.zeros_like(ddg), (-np.inf, ddg), []
    for i in range(1, rounds + 1):
        mu = chemical_potential(energies(background, ddg), protein, dna)
        history.append(log_likelihood(seqs, background, ddg, mu))
        if history[-1] > best[0]:
            best = (history[-1], ddg)
        elif len(history) - 1 - int(np.argmax(history)) >= patience:
            break
        g = gradient(seqs, background, ddg, mu)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        ddg = ddg + rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
        ddg = ddg - ddg.min(1, keepdims=True)
    return best[1], history


def extension_side(seqs: DataFrame, ddg: np.ndarray, reach: int = 3) -> DataFrame:
    """Entropies of the flanks of best sites by distance; low ones say where the motif goes on."""
    best = best_site(scan(seqs.select("seq_id", "seq"), -np.asarray(ddg)), ["seq_id", "seq"]).where("not is_rc")
    n = len(ddg)
    spots = [*range(-reach, 0), *range(n, n + reach)]
    rows = best.withColumn("d", F.explode(F.lit(spots))).withColumn("base", F.when((F.col("offset") + F.col("d")).between(0, F.length("seq") - 1), F.substr("seq", F.col("offset") + F.col("d") + 1, F.lit(1))))
    counts = rows.where("base in ('A','C','G','T')").groupBy("d", "base").agg(F.count("*").alias("n"))
    p = (F.col("n") + 1) / (F.sum("n").over(Window.partitionBy("d")) + 4)
    return counts.withColumn("p", p).groupBy("d").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-6))).alias("entropy"))


def embed(n: int, length: int, motif: str, spark, *, central: bool = False, seed: int = 0) -> DataFrame:
    """Random sequences with a motif at a uniform place, or in the middle."""
    room = length - len(motif)
    at = F.lit(room // 2) if central else F.pmod(F.xxhash64("seq_id", F.lit(seed + 7)), F.lit(room + 1)).cast("int")
    return embedded(pool(spark, n, length, seed), motif, at)


def embedded(seqs: DataFrame, motif: str, at: Column) -> DataFrame:
    """Sequences with a motif in place of what is there."""
    base = seqs.withColumn("at", at)
    return base.select("seq_id", "at", F.concat(F.substr("seq", F.lit(1), F.col("at")), F.lit(motif), F.substr("seq", F.col("at") + len(motif) + 1, F.length("seq"))).alias("seq"))
