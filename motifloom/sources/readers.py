"""Readers of text formats into DataFrames (S1 to S24 of the survey).  Compressed files are read by their suffix."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.sources.genome import numbered_lines

NARROW_PEAK = "contig string, start long, stop long, summit long, score double, signal_value double, p_value double, q_value double, idr_value double, seq string"


def narrow_peak(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Intervals of white-space separated lines; ``track`` lines are skipped, missing columns are -1, a missing
    summit is the middle.  ``limit`` takes the first intervals in the order of files and lines."""
    v = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.coalesce(F.try_element_at(v, F.lit(i + 1)).cast("double"), F.lit(-1.0))
    text = spark.read.text(path) if limit is None else numbered_lines(spark, path)
    lines = text.where(~F.startswith("value", F.lit("track")) & (F.trim("value") != ""))
    if limit is not None:
        lines = lines.orderBy("file", "line").limit(limit)
    start, stop = v[1].cast("long"), v[2].cast("long")
    summit = F.coalesce(F.try_element_at(v, F.lit(10)).cast("double").cast("long"), F.floor((stop - start) / 2))
    return lines.select(v[0].alias("contig"), start.alias("start"), stop.alias("stop"), summit.alias("summit"), number(4).alias("score"), number(6).alias("signal_value"), number(7).alias("p_value"), number(8).alias("q_value"), F.lit(-1.0).alias("idr_value"), F.lit(None).cast("string").alias("seq"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Contig, start, stop and, if there, name and score of tab-separated lines."""
    v = F.split("value", "\t")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[^#\s]+\t\d+\t\d+"))
    return lines.select(v[0].alias("contig"), v[1].cast("long").alias("start"), v[2].cast("long").alias("stop"), F.try_element_at(v, F.lit(4)).alias("name"), F.try_element_at(v, F.lit(5)).cast("double").alias("score"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """S3: a row for each record, its header line (with ``>``) as contig; sequences over several lines are joined.
    Records begin at a ``>`` that begins a line; one within a header stands for itself."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    n = F.length("seq").cast("long")
    return records.select(F.concat(F.lit(">"), head).alias("contig"), seq.alias("seq")).select("contig", F.lit(0).cast("long").alias("start"), n.alias("stop"), F.floor(n / 2).alias("summit"), F.lit(-1.0).alias("score"), "seq")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq) of four-line records, the second line of each.  Files are split between records at lines that
    begin with ``@``.  So may a quality line; what is cut off there is one line, whereas a record has a third line that
    begins with ``+``."""
    records = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split("value", "\r?\n")
    whole = records.where(F.startswith(F.try_element_at(lines, F.lit(3)), F.lit("+")))
    return whole.select(F.input_file_name().alias("file"), F.upper(lines[1]).alias("seq"))


def fastq_round(file: Column) -> Column:
    """The round that a file name's last ``_`` part gives."""
    return F.regexp_extract(file, r"_(\d+)[^_/]*$", 1).cast("int")


def motifs(spark: SparkSession, path: str, factors: list[str] | None = None) -> DataFrame:
    """(name, factor, matrix) of records ``>name`` with rows ``base pA pC pG pT``."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = F.transform(F.slice(lines, 2, 10_000), lambda x: F.transform(F.slice(F.split(F.trim(x), r"\s+"), -4, 4), lambda y: y.cast("double")))
    out = records.select(F.split(F.trim(lines[0]), r"\s+")[0].alias("name"), rows.alias("matrix")).withColumn("factor", F.split("name", "_")[0])
    return out if factors is None else out.where(F.upper("factor").isin([f.upper() for f in factors]))


def energy_file(text: str) -> tuple[str, float, np.ndarray, np.ndarray]:
    """(name, consensus energy, energies, pwm) of a text with one ``.ENERGY`` and one ``.PWM`` block."""
    blocks = [b for b in text.split(">") if b.strip()]
    found = {kind: [b for b in blocks if b.split("\n", 1)[0].split()[0].endswith(kind)] for kind in (".ENERGY", ".PWM")}
    if any(len(v) != 1 for v in found.values()):
        raise ValueError("one .ENERGY and one .PWM block are needed")
    matrix = lambda b: np.array([[float(x) for x in line.split()[-4:]] for line in b.strip().split("\n")[1:]])
    head = found[".ENERGY"][0].split("\n", 1)[0].split()
    return head[0].removesuffix(".ENERGY"), float(head[1]), matrix(found[".ENERGY"][0]), matrix(found[".PWM"][0])


def binding_models(spark: SparkSession, path: str) -> DataFrame:
    """Models as JSON, a row an object; rows without id, name or a matrix of four columns in [0, 1] are errors."""
    rows = spark.read.schema("id string, name string, pwm array<array<double>>").json(path)
    good = F.col("id").isNotNull() & F.col("name").isNotNull() & (F.size("pwm") > 0) & F.forall("pwm", lambda r: (F.size(r) == 4) & F.forall(r, lambda x: (x >= 0) & (x <= 1)))
    return rows.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(F.lit("a binding model is malformed"))))


def table(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """Delimited text with a header, names cleaned."""
    from motifloom.operators.catalog import clean_header

    reader = spark.read.option("sep", sep).option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*(clean_header(c) for c in df.columns))


def wide_scores(df: DataFrame, sample: str, factor: str) -> DataFrame:
    """Of score columns named ``sample|factor|...`` the first that matches both."""
    names = [c for c in df.columns if len(p := c.split("|")) > 1 and p[0].strip() == sample and p[1] == factor]
    if not names:
        raise ValueError(f"no column for {sample} and {factor}")
    return df.select(F.col(f"`{names[0]}`").cast("double").alias("score"))


def sites_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """One-base intervals of a CSV of (number, chr, start, strand, score, ...) with its header dropped."""
    rows = spark.read.csv(path).where(F.col("_c1") != "chr")
    return rows.select(F.col("_c1").alias("contig"), F.col("_c2").cast("long").alias("start"), (F.col("_c2").cast("long") + 1).alias("stop"), F.col("_c5").cast("double").alias("score"))


def listing(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Metadata from file names: a column for each group of a pattern; other files are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(pattern)).select("path", "length", *(F.regexp_extract(name, pattern, i + 1).alias(n) for i, n in enumerate(names)))


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Files of experiments from JSON documents."""
    schema = "accession string, assay string, target string, files array<struct<accession:string,file_format:string,output_type:string,assembly:string,paired_end:string,paired_with:string,href:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("accession").alias("exp_id"), "assay", "target", F.explode("files").alias("f")).select("exp_id", "assay", "target", F.col("f.accession").alias("file_id"), *(F.col(f"f.{c}").alias(c) for c in ("file_format", "output_type", "assembly", "paired_end", "paired_with")), F.col("f.href").alias("file_loc"))


def tracks(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Score tracks (contig, pos, value) stored by contig; a slice prunes folders and row groups."""
    df = spark.read.parquet(path)
    for c, ok in ((contig, F.col("contig") == contig), (start, F.col("pos") >= (start or 0)), (stop, F.col("pos") < (stop or 0))):
        if c is not None:
            df = df.where(ok)
    return df


def reads(spark: SparkSession, *paths: str) -> DataFrame:
    """Aligned reads (contig, pos, aend, strand) of one or several experiments."""
    return spark.read.schema("contig string, pos long, aend long, strand string").parquet(*paths)


def database(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A table of a database; partition options let executors read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """A table kept under a key that follows from its parameters; made if it is not there."""
    path = f"{folder}/{re.sub('[^A-Za-z0-9_.-]', '_', key)}"
    fs = spark._jvm.org.apache.hadoop.fs
    place = fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stem(path: str) -> str:
    return PurePosixPath(path).name.split(".")[0]
