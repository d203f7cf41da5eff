"""Scans of sequences with weight matrices (F7 to F11, F22, F25, G4, J13, J17, W7 of the survey)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from motifloom.functions.physics import EnergyModel, flipped
from motifloom.operators.stats import sorted_quantile

PIECE = 1 << 16  # bases of a piece of a long sequence
CHUNK = 1 << 20  # bases scored at a time
CODES = np.full(256, 4)
for _i, _b in enumerate(b"ACGT"):
    CODES[[_b, _b + 32]] = _i  # both cases


def site_score(seq: Column, offset: Column, matrix: np.ndarray) -> Column:
    """The sum of a matrix over the bases from an offset (from 0); null if one is none of A, C, G, T.

    One CASE for each position: generated code without arrays."""
    def term(i: int) -> Column:
        base = F.substr(seq, offset + (i + 1), F.lit(1))
        return reduce(lambda c, k: c.when(base == "ACGT"[k], F.lit(float(matrix[i][k]))), range(1, 4), F.when(base == "A", F.lit(float(matrix[i][0]))))
    return sum((term(i) for i in range(1, len(matrix))), term(0))


def window_totals(codes: np.ndarray, matrix: np.ndarray, unknown: float) -> np.ndarray:
    """The sum of a matrix over every window of a row of codes (0 to 3, 4 unknown)."""
    n = len(codes) - len(matrix) + 1
    rows = np.column_stack([np.asarray(matrix, float), np.full(len(matrix), unknown)])
    out = rows[0][codes[:n]]
    for i in range(1, len(matrix)):
        out += rows[i][codes[i : i + n]]
    return out


def site_scores(codes: np.ndarray, matrix: np.ndarray, lowest: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every window of a row of codes (0 to 3, 4 unknown) the better strand's score, NaN beside unknowns, and
    whether it is the other strand's."""
    fwd, other = window_totals(codes, matrix, np.nan), window_totals(codes, flipped(matrix), np.nan)
    is_rc = other < fwd if lowest else other > fwd
    return np.where(is_rc, other, fwd), is_rc


def scan(seqs: DataFrame, matrix: np.ndarray | dict[str, np.ndarray], *, lowest: bool = False, unknown: float | None = None, centre_unknown: bool = False, constant: float = 0.0, seq_col: str = "seq") -> DataFrame:
    """A row (``offset``, ``is_rc``, ``site_score``) for every offset, the better of both strands, in upper
    and lower case; with a dict of matrices one for each of them, named ``motif``, in the same pass.

    ``lowest``: energies, else weights; ``constant`` is added.  Windows with another character than A, C, G, T get
    ``unknown``, at their middle if ``centre_unknown``; in the arrays they have no strand, so the sequence is not read
    again.  Sequences pass once, as Arrow batches; long ones are cut into pieces of ``PIECE`` bases there, so that no row
    holds more than the scores of a piece."""
    matrices = matrix if isinstance(matrix, dict) else {"": matrix}
    place = seqs.columns.index(seq_col)
    names = [*seqs.columns, "_motif", "_middle", "_at", "_scores", "_rcs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for name, m in matrices.items():
                for rows, at, sites, scores, is_rc in _scanned(texts, np.asarray(m, float), lowest):
                    bad = np.isnan(scores)
                    values = pa.array(scores + constant, mask=bad) if unknown is None else pa.array(np.where(bad, unknown, scores + constant))
                    ends = pa.array(np.concatenate([[0], np.cumsum(sites)]), pa.int32())
                    own = batch.take(pa.array(rows))
                    lists = [pa.ListArray.from_arrays(ends, values), pa.ListArray.from_arrays(ends, pa.array(is_rc, mask=bad))]
                    middle = pa.array([len(m) // 2 if centre_unknown else 0] * len(rows), pa.int32())
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([name] * len(rows), pa.string()), middle, pa.array(at, pa.int32()), *lists], names=names)

    schema = StructType([*seqs.schema.fields, *(StructField(n, t) for n, t in zip(names[-5:], (StringType(), IntegerType(), IntegerType(), ArrayType(DoubleType()), ArrayType(BooleanType()))))])
    sites = seqs.mapInArrow(run, schema).select("*", F.posexplode(F.arrays_zip("_scores", "_rcs")).alias("_i", "_x"))
    shift = F.when(F.col("_x._rcs").isNull(), F.col("_middle")).otherwise(0)
    motif_name = [F.col("_motif").alias("motif")] if isinstance(matrix, dict) else []
    return sites.select(*seqs.columns, *motif_name, (F.col("_at") + F.col("_i") + shift).cast("int").alias("offset"), F.coalesce("_x._rcs", F.lit(False)).alias("is_rc"), F.col("_x._scores").alias("site_score"))


def _scanned(texts: list[str | None], matrix: np.ndarray, lowest: bool) -> Iterator[tuple]:
    """(rows, first offsets, numbers of sites, scores, strands) of the pieces of texts, about ``CHUNK`` bases at a time."""
    width, pieces, size = len(matrix), [], 0

    def done() -> tuple:
        rows, at, parts = zip(*pieces)
        lengths = np.array([len(x) for x in parts])
        codes = CODES[np.frombuffer("".join(parts).encode("ascii", "replace"), np.uint8)]
        scores, is_rc = site_scores(codes, matrix, lowest)
        whole = np.arange(len(scores)) + width <= np.repeat(np.cumsum(lengths), lengths)[: len(scores)]  # windows that end in their piece
        return rows, at, lengths - width + 1, scores[whole], is_rc[whole]

    for row, text in enumerate(texts):
        for at in range(0, len(text or "") - width + 1, PIECE):
            pieces.append((row, at, text[at : at + PIECE + width - 1]))
            size += len(pieces[-1][2])
            if size > CHUNK:
                yield done()
                pieces, size = [], 0
    if pieces:
        yield done()


def weight_scan(seqs: DataFrame, matrix: np.ndarray, **options) -> DataFrame:
    """the best weight of every offset; windows with N stand at their middle with a quarter for each base."""
    return scan(seqs, matrix, unknown=0.25 * len(matrix), centre_unknown=True, **options)


def energy_scan(seqs: DataFrame, model: EnergyModel, **options) -> DataFrame:
    """F8: the lowest energy of every offset, the consensus energy included; windows with N have the mean energy."""
    return scan(seqs, model.ddg, lowest=True, unknown=model.mean, constant=model.consensus, **options)


def same_length_scan(seqs: DataFrame, matrix: np.ndarray, seq_col: str = "seq") -> DataFrame:
    """both strands at every base: ceil(m/2) - 1 bases of padding before, floor(m/2) after; padding scores 0, and
    so do unknown bases."""
    n, place = len(matrix), seqs.columns.index(seq_col)
    before, after = -(-n // 2) - 1, n // 2
    names = [*seqs.columns, "_at", "_fwd", "_rc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(place).to_pylist()):
                codes = np.concatenate([np.full(before, 4), CODES[np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)], np.full(after, 4)])
                for at in range(0, len(text or ""), PIECE):
                    part = codes[at : at + PIECE + n - 1]
                    lists = [pa.array([window_totals(part, m, 0.0)], pa.list_(pa.float64())) for m in (matrix, flipped(matrix))]
                    yield pa.RecordBatch.from_arrays([*batch.slice(row, 1).columns, pa.array([at], pa.int32()), *lists], names=names)

    schema = StructType([*seqs.schema.fields, *(StructField(c, t) for c, t in zip(names[-3:], (IntegerType(), ArrayType(DoubleType()), ArrayType(DoubleType()))))])
    sites = seqs.mapInArrow(run, schema).select("*", F.posexplode(F.arrays_zip("_fwd", "_rc")).alias("_i", "_x"))
    return sites.select(*seqs.columns, (F.col("_at") + F.col("_i")).alias("offset"), F.col("_x._fwd").alias("fwd"), F.col("_x._rc").alias("rc"))


def best_site(scored: DataFrame, keys: list[str], lowest: bool = False) -> DataFrame:
    """For every sequence its best site; of equal ones that of largest offset on the other strand."""
    sign = -1 if lowest else 1
    x = F.max(F.struct((sign * F.col("site_score")).alias("s"), F.col("offset"), F.col("is_rc"))).alias("x")
    return scored.groupBy(*keys).agg(x).select(*keys, (sign * F.col("x.s")).alias("site_score"), F.col("x.offset").alias("offset"), F.col("x.is_rc").alias("is_rc"))


def region_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean (divided by the length once more), maximum and quantiles .99 .95 .90 .75 .50 of the scores of a region.
    One aggregate: the sorted scores of a region fit a task, as the region itself does."""
    x = F.col("site_score")
    basic = scored.groupBy(*keys).agg((F.avg(x) / F.count(x)).alias("mean"), F.max(x).alias("max"), F.sort_array(F.collect_list(x)).alias("_all"))
    probs = (0.99, 0.95, 0.90, 0.75, 0.50)
    return basic.where(F.size("_all") > 0).select(*keys, "mean", "max", *(sorted_quantile(F.col("_all"), p).alias(f"q{round(p * 100):02d}") for p in probs))


def mean_scores(seqs: DataFrame, motifs: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """For every pair of sequence and motif the mean over offsets of the better strand, in one pass."""
    return scan(seqs, motifs).groupBy(*keys, "motif").agg(F.avg("site_score").alias("mean_score"))


def prefer(primary: DataFrame, fallback: DataFrame, key: str = "tf_id") -> DataFrame:
    """All of the first, and of the second what has no key there."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def preferred_source(models: DataFrame, order: dict[str, int], key: str = "factor") -> DataFrame:
    """The models of each factor that come from its most preferred source."""
    rank = reduce(lambda c, kv: c.when(F.col("name").endswith(kv[0]), kv[1]), list(order.items())[1:], F.when(F.col("name").endswith(next(iter(order))), order[next(iter(order))])).otherwise(len(order))
    ranked = models.withColumn("rank", rank)
    top = ranked.groupBy(key).agg(F.min("rank").alias("rank"))
    return ranked.join(top, [key, "rank"]).drop("rank")
