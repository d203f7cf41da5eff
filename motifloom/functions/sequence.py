"""Sequence functions: plain functions from columns to columns (IDs F1 to F23 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
#: The IUPAC codes and the bases each stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT"}


#: Bases of a piece: taking a substring walks from the string's start, so long sequences are cut before they are scanned.
PIECE = 128


def bound(x: Column, body) -> Column:
    """``body`` of a value that is computed once, also within a function of array elements."""
    return F.transform(F.array(x), body)[0]


def pieces(df: DataFrame, seq_col: str, width: int) -> DataFrame:
    """Rows of a sequence for every place where a window of ``width`` bases begins: ``offset``, and ``piece`` with
    ``within``, the piece that holds the window and its place there."""
    rows = df.where(F.length(seq_col) >= width).withColumn("_at", F.explode(F.sequence(F.lit(0), F.length(seq_col) - width, F.lit(PIECE))))
    rows = rows.withColumn("piece", F.substr(seq_col, F.col("_at") + 1, F.lit(PIECE + width - 1)))
    rows = rows.withColumn("within", F.explode(F.sequence(F.lit(0), F.length("piece") - width)))
    return rows.withColumn("offset", F.col("_at") + F.col("within")).drop("_at")


def reverse_complement(seq: Column) -> Column:
    """reversed, A with T and C with G exchanged, N kept; both cases."""
    return F.translate(F.reverse(seq), "ACGTNacgtn", "TGCANtgcan")


def base_index(base: Column, draw: Column | None = None) -> Column:
    """0 to 3 for A, C, G, T; other characters get ``draw`` (a hash, so results are repeatable) or -1."""
    at = F.instr(F.lit(BASES), F.upper(base)) - 1
    unknown = F.lit(-1) if draw is None else F.pmod(draw, F.lit(4)).cast("int")
    return F.when((F.length(base) == 1) & (at >= 0), at).otherwise(unknown)


def _code_table() -> Column:
    parts = []
    for code, bases in IUPAC.items():
        row = F.array(*(F.lit(float(b in bases) / len(bases)).cast("float") for b in BASES))
        parts += [F.lit(code), row]
    return F.create_map(*parts)


def one_hot(seq: Column, length: int | None = None) -> Column:
    """a row of four shares for each base, IUPAC codes in equal parts, unknown characters and padding as zeros."""
    zero = F.array(*(F.lit(0.0).cast("float") for _ in BASES))
    table = _code_table()
    coded = F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.coalesce(table[c], zero))
    if length is None:
        return coded
    return F.slice(F.concat(coded, F.array_repeat(zero, length)), 1, length)


def one_hot_window(seq: Column, width: int) -> Column:
    """Like ``one_hot``, but a sequence of another length is 0.25 everywhere."""
    flat = F.array_repeat(F.array(*(F.lit(0.25).cast("float") for _ in BASES)), width)
    return F.when(F.length(seq) == width, one_hot(seq, width)).otherwise(flat)


def flip(tensor: Column) -> Column:
    """the reverse complement of a coded sequence, both levels reversed."""
    return F.reverse(F.transform(tensor, F.reverse))


def kmers(seq: Column, k: int, both_strands: bool = True) -> Column:
    """all words of k bases in upper case, those of the forward strand first.  One pass of a pattern that looks ahead:
    a substring for each word would walk from the sequence's start every time."""
    def of(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    words = bound(F.upper(seq), lambda up: F.concat(of(up), bound(reverse_complement(up), of)) if both_strands else of(up))
    return F.when(F.length(seq) >= k, words).otherwise(F.array().cast("array<string>"))


def word_index(seq: Column, k: int) -> Column:
    """for every offset the number whose base-4 digits, lowest first, are the k bases there; null beside unknowns."""
    codes = F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.instr(F.lit(BASES), c) - 1)

    def numbers(digits: Column) -> Column:
        def number(i: Column) -> Column:
            own = [digits[i + j] for j in range(k)]
            return F.when(reduce(lambda a, b: a & b, [d >= 0 for d in own]), sum((d * 4**j for j, d in enumerate(own)), F.lit(0)))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(digits) - k, F.lit(0))), number)

    return F.when(F.length(seq) >= k, bound(codes, numbers)).otherwise(F.array().cast("array<int>"))


def nth_kmer(i: Column, k: int) -> Column:
    """the i-th of all 4**k words in order."""
    return F.concat(*(F.substr(F.lit(BASES), F.pmod(F.floor(i / F.lit(4 ** (k - 1 - j))), F.lit(4)).cast("int") + 1, F.lit(1)) for j in range(k)))


def all_kmers(spark, k: int) -> DataFrame:
    """(word) of all 4**k words, generated where they are used."""
    return spark.range(4**k).select(nth_kmer(F.col("id"), k).alias("word"))


def random_sequence(key: Column, length: int, seed: int = 0) -> Column:
    """a uniform sequence that follows from key and seed."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(F.lit(BASES), F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(4)).cast("int") + 1, F.lit(1))), "")


def split_primer(primer: Column) -> tuple[Column, Column, Column]:
    """(left flank, number of random bases, right flank) of a primer such as ``TCCATCACG20NTGCA``."""
    return F.regexp_extract(primer, r"^(.*?)[0-9]{1,4}N", 1), F.regexp_extract(primer, r"([0-9]{1,4})N", 1).cast("int"), F.regexp_extract(primer, r"[0-9]{1,4}N(.*)$", 1)


def with_flanks(seq: Column, left: Column, right: Column, width: int) -> Column:
    """flanks of ``width`` bases around a sequence, padded outwards with N."""
    return F.concat(F.lpad(F.substr(left, F.greatest(F.length(left) - width + 1, F.lit(1)), F.lit(width)), width, "N"), seq, F.rpad(F.substr(right, F.lit(1), F.lit(width)), width, "N"))


def cache_key(*parts: Column) -> Column:
    """a key that follows from its parts."""
    return F.sha1(F.concat_ws("\x1f", *parts))
