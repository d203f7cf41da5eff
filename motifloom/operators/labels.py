"""Labels 1 (bound), 0 (unbound) and -1 (ambiguous): combination, filters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.operators.ordered import numbered

TEST_CONTIGS = ("chr1", "chr2")
VALIDATION_CONTIGS = ("chr8", "chr9")


def checked(label: Column) -> Column:
    """The label, an error if it is none of the three."""
    return F.when(label.isin(-1, 0, 1), label).otherwise(F.raise_error(F.concat(F.lit("not a label: "), label.cast("string"))))


def from_legacy(label: Column) -> Column:
    """Of the older convention, where 0 is ambiguous and -1 negative."""
    return F.when(label == 0, -1).when(label == -1, 0).otherwise(label)


def combine(per_file: DataFrame, key: str = "row_id") -> DataFrame:
    """Of labels and scores by (key, pk_type) the label and score of every key.  A key without a label 1 among
    optimal peaks is ambiguous if a relaxed one has it, its score then being the largest of all."""
    optimal, relaxed = F.col("pk_type") == "optimal", F.col("pk_type") == "relaxed"
    agg = per_file.groupBy(key).agg(F.coalesce(F.max(F.when(optimal, F.col("label"))), F.lit(0)).alias("o"), F.coalesce(F.max(F.when(relaxed, F.col("label"))), F.lit(0)).alias("r"), F.max(F.when(optimal, F.col("score"))).alias("so"), F.max("score").alias("s"))
    unsure = (F.col("o") <= 0) & (F.col("r") == 1)
    return agg.select(key, F.when(unsure, -1).otherwise(F.col("o")).alias("label"), F.coalesce(F.when(unsure, F.col("s")).otherwise(F.col("so")), F.lit(0.0)).alias("score"))


def eligible(files: DataFrame, include_ambiguous: bool) -> DataFrame:
    """Samples with what they need: files, optimal ones, and relaxed ones if ambiguous labels are wanted."""
    has = files.groupBy("sample_id").agg(F.max((F.col("pk_type") == "optimal").cast("int")).alias("o"), F.max((F.col("pk_type") == "relaxed").cast("int")).alias("r"))
    return has.where("r = 1" if include_ambiguous else "o = 1").select("sample_id")


def subset(df: DataFrame, samples=None, contigs=None) -> DataFrame:
    """Rows of given samples and contigs; None does not restrict."""
    for c, values in (("sample_id", samples), ("contig", contigs)):
        if values is not None:
            df = df.where(F.col(c).isin(list(values)))
    return df


def remove(df: DataFrame, samples, contigs) -> DataFrame:
    """P5: rows that have neither a given sample nor a given contig."""
    return df.where(~F.col("sample_id").isin(list(samples)) & ~F.col("contig").isin(list(contigs)))


def by_contig(df: DataFrame, include=None, exclude=None) -> DataFrame:
    """Rows of the included contigs, or of all but the excluded ones; exactly one of both is given."""
    if (include is None) == (exclude is None):
        raise ValueError("give contigs to include or contigs to exclude")
    return df.where(F.col("contig").isin(list(include)) if include is not None else ~F.col("contig").isin(list(exclude)))


def unambiguous(df: DataFrame) -> DataFrame:
    """P6."""
    return df.where("label <> -1")


def clean_label(optimal: Column, relaxed: Column) -> Column:
    """Ambiguous where either says so or both differ."""
    return F.when((optimal < -0.5) | (relaxed < -0.5) | (optimal != relaxed), -1).otherwise(optimal)


def imputed(label: Column, score: Column, threshold: float) -> Column:
    """Ambiguous labels become 1 above the threshold and 0 below."""
    return F.when(label == -1, F.when(score > threshold, 1).otherwise(0)).otherwise(label)


def merged_label(text: Column) -> Column:
    """The first of comma-separated labels."""
    return checked(F.split(text, ",")[0].cast("int"))


def contig_split(contig: Column) -> Column:
    """Validation contigs, test contigs, and the rest for training."""
    return F.when(contig.isin(*VALIDATION_CONTIGS), "validation").when(contig.isin(*TEST_CONTIGS), "test").otherwise("train")


def matrix(df: DataFrame, tfs: list[str], key: str = "row_id") -> DataFrame:
    """A row for each key and a column for each factor in order, absent factors -1."""
    wide = df.groupBy(key).pivot("tf_id", tfs).agg(F.max("label"))
    return wide.select(key, *(F.coalesce(F.col(f"`{t}`"), F.lit(-1)).alias(t) for t in tfs))


def factor_name(name: Column) -> Column:
    """P10."""
    return F.regexp_replace(name, "^eGFP-", "")


def region_id(*parts: Column, width: int = 30) -> Column:
    """Parts joined by ``_`` and padded to a width."""
    joined = F.concat_ws("_", *parts)
    return F.when(F.length(joined) < width, F.rpad(joined, width, " ")).otherwise(joined)


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    """The columns of a kind."""
    return [c for c in df.columns if c.startswith(prefix)]


def positional(df: DataFrame, order: list[str], start: int, stop: int, step: int = 1, partition: list[str] | None = None) -> DataFrame:
    """Rows by position in an order that begins with a number."""
    at = F.col("row_upto") - 1
    return numbered(df, partition or [], order).where(at.between(start, stop - 1) & ((at - start) % step == 0)).select(*df.columns)
