"""Metadata queries over tables of experiments, files, factors and samples (Q1 to Q20, J5 to J21, W8, G8 to G10, U1 to
U8, K11, P12, P13, P20 to P23 of the survey)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, **given) -> DataFrame:
    """Equality with each argument that is not None; lists mean one of."""
    for column, value in given.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def exactly_one(**selectors) -> tuple[str, Sequence]:
    """The one selector that is given; an error for none or several."""
    given = [(k, v) for k, v in selectors.items() if v is not None]
    if len(given) != 1:
        raise ValueError(f"give exactly one of {', '.join(selectors)}")
    return given[0]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """By all columns of the same name."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group; the order ends with a unique key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def missing(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not among the known ones, SQL's NOT IN: nothing if a known one is null, all rows if
    none is known.  An anti join, so that the known side may have any size."""
    if known.where(F.col(column).isNull()).limit(1).count():
        return df.limit(0)
    if not known.limit(1).count():
        return df
    return df.where(F.col(column).isNotNull()).join(known.select(column), column, "left_anti")


def find_or_insert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What exists, and of the new rows those without a match; of several the smallest."""
    fresh = new.groupBy(*key).agg(*(F.min(c).alias(c) for c in new.columns if c not in key)).select(*new.columns)
    return existing.unionByName(fresh.join(existing.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What exists, its columns set to the new rows' values where the key matches and these are not null;
    and the new rows without a match.  Of several new rows with a key the smallest values count."""
    rest = [c for c in existing.columns if c not in key]
    fresh = new.groupBy(*key).agg(*(F.min(c).alias(f"_new_{c}") for c in rest))
    return existing.join(fresh, key, "full").select(*(c if c in key else F.coalesce(f"_new_{c}", c).alias(c) for c in existing.columns))


def resolved_targets(names: DataFrame, targets: DataFrame, special: dict[str, str], prefix: str = "") -> DataFrame:
    """(name, tf_id) of target names: by a fixed table of special cases, else by the id that a prefix and the
    name make, else by one of a target's aliases; null where none or several match."""
    table = F.create_map(*(F.lit(x) for kv in special.items() for x in kv)) if special else None
    own = names.select("name").distinct()
    by_table = own.select("name", (table[F.col("name")] if special else F.lit(None).cast("string")).alias("tf_id")).where("tf_id is not null")
    by_id = own.join(targets.select("tf_id", "dbid"), F.concat(F.lit(prefix), F.col("name")) == F.col("dbid")).select("name", "tf_id")
    by_alias = targets.select("tf_id", F.explode("aliases").alias("name")).join(own, "name", "left_semi").select("name", "tf_id")
    return by_fallback(names, [by_table, by_id, by_alias], "name", "tf_id")


def registered_peaks(files: DataFrame, targets: DataFrame, known: DataFrame, special: dict[str, str], prefix: str = "") -> DataFrame:
    """Files of relaxed peaks with a resolved target that are not registered yet, with their type and name."""
    found = resolved_targets(files.withColumnRenamed("target", "name"), targets, special, prefix).where("tf_id is not null")
    named = found.select("sample_id", "tf_id", F.lit("relaxed").alias("pk_type"), file_name(F.col("sample_id"), F.col("name"), F.lit("relaxed"), F.lit("bed.gz")).alias("fname"))
    return named.join(known.select("fname"), "fname", "left_anti").select("sample_id", "tf_id", "pk_type", "fname")


def files_by_sample(files: DataFrame) -> DataFrame:
    """For each sample its factors, each with its files as (type, file)."""
    per = files.groupBy("sample_id", "tf_id").agg(F.sort_array(F.collect_set(F.struct(F.col("pk_type"), F.col("fname")))).alias("files"))
    return per.groupBy("sample_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tf_id", "files")))).alias("factors"))


def with_sample_labels(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of several samples, each with a one-hot label of its sample in the given order."""
    names = list(parts)
    rows = [df.withColumns({"sample_id": F.lit(n), "sample_label": F.lit([float(n == m) for m in names])}) for n, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def by_fallback(wanted: DataFrame, steps: list[DataFrame], key: str, found: str) -> DataFrame:
    """The hit of the first step that has exactly one; null if none has."""
    out = wanted
    for i, step in enumerate(steps):
        one = step.groupBy(key).agg(F.min(found).alias(f"_f{i}"), F.countDistinct(found).alias("_n")).where("_n = 1").drop("_n")
        out = out.join(one, key, "left")
    return out.select(*wanted.columns, F.coalesce(*(F.col(f"_f{i}") for i in range(len(steps)))).alias(found))


def one_or_list(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A sorted list of the matches and how many there are."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("matches")).withColumn("n", F.size("matches"))


def listed(df: DataFrame, keys: list[str], value: str, distinct: bool = False) -> DataFrame:
    """Sorted lists by group."""
    collect = F.collect_set if distinct else F.collect_list
    return df.groupBy(*keys).agg(F.sort_array(collect(value)).alias("values"))


def single_value(df: DataFrame, column: str):
    """The only value of a column; an error if there are several."""
    values = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if len(values) != 1:
        raise ValueError(f"{column} should have one value")
    return values[0]


def mates(files: DataFrame) -> DataFrame:
    """(r1, r2) of paired files, each pair once."""
    a, b = files.alias("a"), files.alias("b")
    pairs = a.join(b, (F.col("a.paired_with") == F.col("b.file_id")) & (F.col("b.paired_with") == F.col("a.file_id")))
    return pairs.where(F.col("a.paired_end") == 1).select(F.col("a.file_id").alias("r1"), F.col("b.file_id").alias("r2"))


def replicate(files: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The biosample of a replicate, ``merged`` where there is none."""
    return files.join(names, keys, "left").withColumn("bsid", F.coalesce("bsid", F.lit("merged")))


def samples_with_factor(peaks: DataFrame, known: DataFrame, factor: str | None = None) -> DataFrame:
    """Samples that have peaks of a factor and are known, in order."""
    rows = where_all(peaks, tf_id=factor)
    return rows.join(known, "sample_id", "left_semi").select("sample_id").distinct().orderBy("sample_id")


def usable(experiments: DataFrame, excluded: DataFrame, least_length: int = 20) -> DataFrame:
    """Experiments with a background and long enough sequences that are not excluded."""
    return experiments.where(F.col("has_background") & (F.col("seq_length") >= least_length)).join(excluded, "exp_id", "left_anti")


def peak_files(files: DataFrame, assembly: str) -> DataFrame:
    """Bed files of peaks of an assembly."""
    return files.where((F.col("file_format") == "bed") & F.col("output_type").isin("peaks", "optimal idr thresholded peaks") & (F.col("assembly") == assembly))


def analysed(df: DataFrame) -> DataFrame:
    """Without the mitochondrial contig, rows flagged -1 and histone targets."""
    return df.where((F.col("contig") != "chrM") & (F.col("quality") != -1) & ~F.col("target").rlike("^H[0-9]"))


def file_name(exp: Column, sample_type: Column, target: Column, extension: Column) -> Column:
    """P20: blanks become ``__``, slashes ``-``."""
    clean = lambda c: F.replace(F.replace(c, F.lit(" "), F.lit("__")), F.lit("/"), F.lit("-"))
    return F.concat_ws(".", exp, clean(sample_type), clean(target), extension)


def peak_type(name: Column) -> Column:
    """P20: short names of peak types; an error for an unknown one."""
    return F.when(name == "optimal idr thresholded peaks", "optimal").when(name.contains("relaxed"), "relaxed").when(name == "peaks", "peaks").otherwise(F.raise_error(F.concat(F.lit("unknown type of peaks: "), name)))


def looked_up(column: Column, table: dict[str, str]) -> Column:
    """By a fixed table."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[column]


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """Concatenation, difference, intersection or union."""
    return {"all": left.unionByName, "except": left.subtract, "intersect": left.intersect, "union": lambda r: left.unionByName(r).distinct()}[kind](right)


def url_matrix(files: DataFrame, keys: list[str]) -> DataFrame:
    """U8: addresses of a role joined by commas, roles by semicolons."""
    roles = files.groupBy(*keys, "role").agg(F.array_join(F.sort_array(F.collect_list("url")), ",").alias("urls"))
    return roles.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("role", "urls"))), lambda x: x["urls"]), ";").alias("matrix"))


def claim(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Q20: the first n tasks of a queue, and what is left."""
    taken = queue.orderBy("task_id").limit(n)
    return taken, queue.join(taken.select("task_id"), "task_id", "left_anti")


def uniprot_ids(dbxrefs: Column) -> Column:
    """the accessions of references such as ``UniProtKB:P12345``."""
    return F.transform(F.filter(dbxrefs, lambda x: F.startswith(x, F.lit("UniProtKB:"))), lambda x: F.substr(x, F.lit(11)))


def gene_ids(text: Column) -> Column:
    """The distinct Ensembl ids of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"ENS[A-Z]*G[0-9]{11}"), F.lit(0))))


def clean_header(name: str) -> str:
    """Runs of other characters than letters, digits and ``_`` become ``_``."""
    import re

    return re.sub(r"\W+", "_", name).strip("_")
