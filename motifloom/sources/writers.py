"""Writers (K1 to K14 of the survey).  All write folders of part files in parallel; none gathers rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, path: str, compression: str = "gzip", header: bool = True) -> None:
    """Tab-separated values."""
    df.write.option("sep", "\t").option("header", header).option("compression", compression).csv(path)


def matrix(df: DataFrame, path: str, rows: str, columns: str, value: str, names: list[str]) -> None:
    """A row for each ``rows``, a column for each name; the names, sorted, are lines of text in ``path.tfnames``."""
    df.groupBy(rows).pivot(columns, names).agg(F.max(value)).write.parquet(path)
    lines = df.sparkSession.createDataFrame([(n,) for n in sorted(names)], "value string")
    lines.coalesce(1).write.text(f"{path}.tfnames")


def scores(df: DataFrame, path: str) -> None:
    """K5, K6: by contig, in order; an error if the folder exists."""
    df.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").write.mode("errorifexists").partitionBy("contig").parquet(path)


def bed_graph(df: DataFrame, path: str) -> None:
    """K7: ``contig start stop score`` of single positions."""
    df.select("contig", "pos", (F.col("pos") + 1).alias("stop"), "score").write.option("sep", "\t").csv(path)


def fasta(df: DataFrame, path: str, name: str = "contig", seq: str = "seq") -> None:
    """K8."""
    df.select(F.concat(F.lit(">"), F.regexp_replace(name, "^>", ""), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def fastq(df: DataFrame, path: str, name: str = "seq_id", seq: str = "seq") -> None:
    """K8: with qualities of ``I``."""
    df.select(F.concat(F.lit("@"), F.col(name).cast("string"), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq))).alias("value")).write.text(path)


def bed(df: DataFrame, path: str, columns: tuple[str, ...] = ("contig", "start", "stop")) -> None:
    """K8."""
    df.select(*columns).write.option("sep", "\t").csv(path)


def sorted_intervals(df: DataFrame, path: str) -> None:
    """Intervals in the order of contig, start and stop over all part files."""
    df.repartitionByRange("contig", "start", "stop").sortWithinPartitions("contig", "start", "stop").write.option("sep", "\t").option("compression", "gzip").csv(path)


def motif_text(name: str, pwm: np.ndarray) -> str:
    """K9: a motif record."""
    return f">{name}\n" + "".join("ACGT"[int(np.argmax(r))] + " " + " ".join(f"{x:.6f}" for x in r) + "\n" for r in pwm)


def model_yaml(name: str, ddg: np.ndarray, consensus: float) -> str:
    """K9: an energy model."""
    rows = "".join("  - [" + ", ".join(f"{x:.6f}" for x in r) + "]\n" for r in ddg)
    return f"name: {name}\nconsensus_energy: {consensus:.6f}\nddg_array:\n{rows}"
