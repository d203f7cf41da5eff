"""Shape features of five-base words, and energies from differences of bases with and without them.

A lookup table gives each of the 1024 words of five bases its features, which stand for the word's middle base; on the
other strand a base has the features of the reverse complement.  The table is a parameter: a DataFrame of ``word`` and the
features, of which at most 1024 rows are held."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from motifloom.operators.motif import CODES

WORD = 5
PART = 1 << 20  # bases worked on at a time


def lookup(table: DataFrame, features: list[str]) -> np.ndarray:
    """Features by the number of a word, its first base counting most; words that are not in the table have zeros."""
    rows = table.select("word", *features).limit(4**WORD + 1).collect()
    if len(rows) > 4**WORD or any(len(r["word"]) != WORD or set(r["word"]) - set("ACGT") for r in rows):
        raise ValueError(f"a table of words of {WORD} bases has one row for each at most")
    out = np.zeros((4**WORD, len(features)))
    for r in rows:
        out[int("".join(str("ACGT".index(b)) for b in r["word"]), 4)] = [float(r[f]) for f in features]
    return out


def shapes(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every base on its own and on the other strand; bases without two known ones on each side have zeros."""
    n, fwd, rc = len(codes), np.zeros((len(codes), table.shape[1])), np.zeros((len(codes), table.shape[1]))
    if n >= WORD:
        windows = np.lib.stride_tricks.sliding_window_view(codes, WORD)
        known = (windows < 4).all(1)
        power = 4 ** np.arange(WORD - 1, -1, -1)
        at = np.flatnonzero(known)
        fwd[at + WORD // 2] = table[windows[known] @ power]
        rc[at + WORD // 2] = table[(3 - windows[known][:, ::-1]) @ power]
    return fwd, rc


def _codes(text: str) -> np.ndarray:
    return CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def _by_sequence(seqs: DataFrame, seq_col: str, of, names: list[str]) -> DataFrame:
    """The other columns of every row and numbers made from its sequence (null without one)."""
    place = seqs.columns.index(seq_col)
    others = [c for c in seqs.columns if c != seq_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(_codes(t)) if t else None for t in batch.column(place).to_pylist()]
            columns = [pa.array([None if x is None or np.isnan(x[i]) else float(x[i]) for x in found], pa.float64()) for i in range(len(names))]
            kept = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*others, *names])

    schema = StructType([*(f for f in seqs.schema.fields if f.name != seq_col), *(StructField(n, DoubleType()) for n in names)])
    return seqs.mapInArrow(run, schema)


def shape_sums(seqs: DataFrame, table: DataFrame, features: list[str], seq_col: str = "seq") -> DataFrame:
    """the sums of each feature over a sequence, as ``<feature>_fwd`` and ``<feature>_rc``."""
    known, step = lookup(table, features), PART

    def of(codes: np.ndarray) -> np.ndarray:
        total = np.zeros(2 * len(features))
        for at in range(0, len(codes), step):  # with the neighbours that the words at the borders need
            low = max(0, at - WORD // 2)
            part = shapes(codes[low : at + step + WORD // 2], known)
            own = slice(at - low, at - low + step)
            total += np.concatenate([x[own].sum(0) for x in part])
        return total

    return _by_sequence(seqs, seq_col, of, [f"{f}_{s}" for s in ("fwd", "rc") for f in features])


def site_energies(codes: np.ndarray, differences: np.ndarray, shape: np.ndarray | None = None, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """energies of the sites of both strands: for each position what C, G and T add to A (rows C, G, T), and a row of
    weights of each shape feature.  Sites with an unknown base have none (NaN).

    The other strand's sites are read without turning the sequence: there T is A, so a base counts from the difference
    of T, which is added for every position."""
    width = differences.shape[1]
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0), np.empty(0)
    own = np.vstack([np.zeros(width), differences, np.full(width, np.nan)])
    other = np.vstack([differences[2], differences[1], differences[0], np.zeros(width), np.full(width, np.nan)])[:, ::-1]
    fwd, rc = np.zeros(n), np.zeros(n)
    for i in range(width):
        fwd += own[codes[i : i + n], i]
        rc += other[codes[i : i + n], i]
    if shape is not None:
        for_own, for_other = shapes(codes, table)
        for i in range(width):
            fwd += for_own[i : i + n] @ shape[:, i]
            rc += for_other[i : i + n] @ shape[:, width - 1 - i]
    return fwd, rc


def affinities(seqs: DataFrame, differences: np.ndarray, *, shape: np.ndarray | None = None, table: DataFrame | None = None, features: list[str] | None = None, seq_col: str = "seq") -> DataFrame:
    """``energy``, the lowest over all sites and both strands of every sequence, null where there is none."""
    known = None if shape is None else lookup(table, features)
    width, step = np.asarray(differences).shape[1], PART

    def of(codes: np.ndarray) -> np.ndarray:
        best = np.inf
        for at in range(0, len(codes), step):
            low = max(0, at - WORD // 2)
            part = codes[low : at + step + width - 1 + WORD // 2]
            fwd, rc = site_energies(part, np.asarray(differences, float), shape, known)
            both = np.concatenate([x[at - low : at - low + step] for x in (fwd, rc)])
            both = both[~np.isnan(both)]
            best = min(best, both.min()) if len(both) else best
        return np.array([best if np.isfinite(best) else np.nan])

    return _by_sequence(seqs, seq_col, of, ["energy"])
