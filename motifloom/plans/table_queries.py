"""Queries on tables of files, experiments and targets, beside those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from motifloom.operators import catalog
from motifloom.plans import programs
from motifloom.plans.registry import in_text, query
from motifloom.plans.views import table


@query("SELECT s_suppkey AS id, CASE WHEN n.new IS NULL THEN s_name ELSE n.new END AS name FROM supplier LEFT JOIN (SELECT c_custkey, min(c_mktsegment) AS new FROM customer WHERE c_acctbal > 0 GROUP BY 1) n ON n.c_custkey = s_suppkey UNION ALL SELECT c_custkey, min(c_mktsegment) FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def upserted_names(s, d):
    old = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return catalog.upsert(old, table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")), ["id"])


_TARGETS = "WITH names AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT n_name FROM nation UNION SELECT 'k' || n_nationkey FROM nation), special AS (SELECT n_name AS name, 'special' AS tf_id FROM nation WHERE n_nationkey = 3), byid AS (SELECT 'k' || n_nationkey AS name, 'T' || n_nationkey AS tf_id FROM nation WHERE n_nationkey < 20), alias AS (SELECT name, min(tf_id) AS tf_id FROM (SELECT n_name AS name, 'T' || n_nationkey AS tf_id FROM nation UNION SELECT 'k' || (n_nationkey + 10), 'T' || n_nationkey FROM nation UNION SELECT p_brand, 'T' || (CAST(substr(p_brand, 7) AS INTEGER) % 25) FROM part) GROUP BY 1 HAVING count(DISTINCT tf_id) = 1), found AS (SELECT n.name, coalesce(s.tf_id, b.tf_id, a.tf_id) AS tf_id FROM names n LEFT JOIN special s USING (name) LEFT JOIN byid b USING (name) LEFT JOIN alias a USING (name))"


def _targets(s, d):
    n, p = table(s, d, "nation"), table(s, d, "part")
    names = p.select(F.col("p_brand").alias("name")).union(n.select("n_name")).union(n.select(F.concat(F.lit("k"), "n_nationkey"))).distinct()
    key = F.concat(F.lit("T"), F.col("n_nationkey"))
    brands = p.groupBy((F.substring("p_brand", 7, 9).cast("int") % 25).alias("k")).agg(F.collect_set("p_brand").alias("brands"))
    own = n.join(brands, F.col("n_nationkey") == F.col("k"), "left")
    aliases = F.concat(F.array("n_name", F.concat(F.lit("k"), F.col("n_nationkey") + 10)), F.coalesce("brands", F.array().cast("array<string>")))
    targets = own.select(key.alias("tf_id"), F.when(F.col("n_nationkey") < 20, F.concat(F.lit("id:k"), F.col("n_nationkey"))).alias("dbid"), aliases.alias("aliases"))
    return names, targets


def _special(s, d):
    return {table(s, d, "nation").where("n_nationkey = 3").first()["n_name"]: "special"}  # one row of 25


@query(_TARGETS + " SELECT name, tf_id FROM found")
def resolved_targets(s, d):
    names, targets = _targets(s, d)
    return catalog.resolved_targets(names, targets, _special(s, d), "id:")


@query(_TARGETS + " SELECT 'E1' AS sample_id, tf_id, 'relaxed' AS pk_type, 'E1.' || replace(replace(name, ' ', '__'), '/', '-') || '.relaxed.bed.gz' AS fname FROM found WHERE tf_id IS NOT NULL AND name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 5)")
def registered_peaks(s, d):
    names, targets = _targets(s, d)
    known = table(s, d, "nation").where("n_nationkey < 5").select(catalog.file_name(F.lit("E1"), F.col("n_name"), F.lit("relaxed"), F.lit("bed.gz")).alias("fname"))
    return catalog.registered_peaks(names.select(F.lit("E1").alias("sample_id"), F.col("name").alias("target")), targets, known, _special(s, d), "id:")


@query("SELECT n_regionkey AS sample_id, string_agg(f, ';' ORDER BY tf_id) AS factors FROM (SELECT n_regionkey, n_nationkey % 3 AS tf_id, (n_nationkey % 3) || ':' || string_agg(length(n_name) || '/' || n_name, ',' ORDER BY length(n_name), n_name) AS f FROM nation GROUP BY 1, 2) GROUP BY 1")
def files_by_sample(s, d):
    files = table(s, d, "nation").select(F.col("n_regionkey").alias("sample_id"), (F.col("n_nationkey") % 3).alias("tf_id"), F.length("n_name").alias("pk_type"), F.col("n_name").alias("fname"))
    entry = lambda x: F.concat(x["key"].cast("string"), F.lit(":"), F.array_join(F.transform(x["value"], lambda y: F.concat_ws("/", y["pk_type"].cast("string"), y["fname"])), ","))
    return catalog.files_by_sample(files).select("sample_id", F.array_join(F.transform(F.map_entries("factors"), entry), ";").alias("factors"))


@query("SELECT n_nationkey AS id, 'nation' AS sample_id, '1.0,0.0' AS sample_label FROM nation UNION ALL SELECT r_regionkey, 'region', '0.0,1.0' FROM region")
def sample_labels(s, d):
    parts = {"nation": table(s, d, "nation").select(F.col("n_nationkey").alias("id")), "region": table(s, d, "region").select(F.col("r_regionkey").alias("id"))}
    return in_text(catalog.with_sample_labels(parts), "sample_label")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN 'B' || s_nationkey ELSE 'merged' END AS bsid FROM supplier")
def replicates(s, d):
    names = table(s, d, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("B"), F.col("n_nationkey")).alias("bsid"))
    return catalog.replicate(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), names, ["s_nationkey"]).select("s_suppkey", "bsid")


@query("SELECT DISTINCT c_nationkey AS sample_id FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def samples_with_factor(s, d):
    peaks = table(s, d, "customer").select(F.col("c_nationkey").alias("sample_id"), F.col("c_mktsegment").alias("tf_id"))
    first = peaks.agg(F.min("tf_id").alias("tf_id"))
    return catalog.samples_with_factor(peaks.join(F.broadcast(first), "tf_id", "left_semi"), table(s, d, "supplier").select(F.col("s_nationkey").alias("sample_id")))  # one row


@query("SELECT p_partkey AS exp_id FROM part WHERE p_retailprice > 920 AND p_size >= 20 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def usable_experiments(s, d):
    x = table(s, d, "part").select(F.col("p_partkey").alias("exp_id"), (F.col("p_retailprice") > 920).alias("has_background"), F.col("p_size").alias("seq_length"))
    return catalog.usable(x, table(s, d, "supplier").select(F.col("s_suppkey").alias("exp_id"))).select("exp_id")


@query("SELECT p_partkey FROM part WHERE p_size % 4 IN (0, 1) AND p_partkey % 2 = 0")
def peak_files(s, d):
    size = F.col("p_size") % 4
    kind = F.when(size == 0, "peaks").when(size == 1, "optimal idr thresholded peaks").otherwise("signal")
    files = table(s, d, "part").select("p_partkey", F.lit("bed").alias("file_format"), kind.alias("output_type"), F.when(F.col("p_partkey") % 2 == 0, "hg19").otherwise("mm9").alias("assembly"))
    return catalog.peak_files(files, "hg19").select("p_partkey")


@query("SELECT event_id FROM events WHERE user_id % 9 <> 0 AND event_id % 7 <> 0 AND NOT event_type = 'view'")
def analysed_rows(s, d):
    contig = F.when(F.col("user_id") % 9 == 0, "chrM").otherwise("chr1")
    rows = table(s, d, "events").select("event_id", contig.alias("contig"), F.when(F.col("event_id") % 7 == 0, -1).otherwise(1).alias("quality"), F.when(F.col("event_type") == "view", "H3K27ac").otherwise("CTCF").alias("target"))
    return catalog.analysed(rows).select("event_id")


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS name FROM nation")
def looked_up_names(s, d):
    return table(s, d, "nation").select("n_nationkey", catalog.looked_up(F.col("n_regionkey").cast("string"), {"0": "zero", "1": "one"}).alias("name"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'optimal' WHEN 1 THEN 'relaxed' ELSE 'peaks' END AS kind FROM part")
def peak_types(s, d):
    size = F.col("p_size") % 3
    name = F.when(size == 0, "optimal idr thresholded peaks").when(size == 1, "relaxed peaks").otherwise("peaks")
    return table(s, d, "part").select("p_partkey", catalog.peak_type(name).alias("kind"))


@query("SELECT p_partkey, 'P' || p_partkey AS ids, 'ENSG' || lpad(p_size::VARCHAR, 11, '0') || CASE WHEN p_size < 9 THEN ',ENSMUSG00000000009' ELSE ',ENSMUSG00000000009' END AS genes FROM part")
def identifiers(s, d):
    refs = F.array(F.concat(F.lit("UniProtKB:P"), F.col("p_partkey")), F.concat(F.lit("RefSeq:"), F.col("p_size")))
    gene = F.concat(F.lit("ENSG"), F.lpad(F.col("p_size").cast("string"), 11, "0"))
    text = F.concat_ws(" and ", F.lit("ENSMUSG00000000009"), gene, gene)
    return in_text(in_text(table(s, d, "part").select("p_partkey", catalog.uniprot_ids(refs).alias("ids"), catalog.gene_ids(text).alias("genes")), "ids"), "genes")


@query("SELECT a.s_suppkey, b.p_partkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) a JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) b USING (i)")
def zipped_rows(s, d):
    return programs.zipped(table(s, d, "supplier").select("s_suppkey"), table(s, d, "part").select("p_partkey"), "s_suppkey", "p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 25")
def claimed_tasks(s, d):
    return catalog.claim(table(s, d, "orders").select(F.col("o_orderkey").alias("task_id")), 25)[0].withColumnRenamed("task_id", "o_orderkey")
