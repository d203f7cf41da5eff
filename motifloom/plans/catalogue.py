"""The engine's own queries and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.functions import physics, sequence
from motifloom.operators import catalog, coverage, intervals, labels, metrics, models, motif, sampling, selex, stats
from motifloom.plans import file_queries, fit_queries, programs, sequence_queries, table_queries, views  # noqa: F401 (these enter their queries)
from motifloom.plans.registry import in_text, oracle_sql, queries, query, rounded  # noqa: F401
from motifloom.plans.views import sql, table

def labelled(s: SparkSession, d: str) -> DataFrame:
    cen, chip = views.windows(s, d), views.observed(s, d)
    parts = [intervals.best_overlap(cen, chip.where(F.col("pk_type") == k)).withColumn("pk_type", F.lit(k)) for k in ("optimal", "relaxed")]
    found = labels.combine(parts[0].unionByName(parts[1]))
    return cen.select("row_id", "sample_id", "contig", "signal_value").join(found, "row_id")


# -- intervals and labels ----------------------------------------------------------------------------------------------


@query(sql("ev acc cen chip pairs best labelled final", "SELECT row_id, sample_id, contig, CAST(label AS INTEGER) AS label, round(score, 6) AS score FROM final"))
def peak_labels(s, d):
    return rounded(labelled(s, d).select("row_id", "sample_id", "contig", F.col("label").cast("int").alias("label"), "score"), "score")


@query(sql("ev acc cen chip pairs best labelled final", "SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM final GROUP BY 1"))
def peak_label_counts(s, d):
    return labelled(s, d).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query(sql("ev acc cen", "SELECT row_id, contig || ':' || start || '-' || stop || '_' || summit AS identifier, stop - start AS width FROM cen"))
def centred_peaks(s, d):
    return views.windows(s, d).select("row_id", intervals.identifier().alias("identifier"), (F.col("stop") - F.col("start")).alias("width"))


@query(sql("ev acc cen chip pairs", "SELECT c.row_id, round(coalesce(b.fraction, 0), 6) AS fraction, CASE WHEN b.fraction > 0.5 THEN 1 ELSE 0 END AS label, round(CASE WHEN b.fraction > 0.5 THEN b.score ELSE 0 END, 6) AS score FROM cen c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY fraction DESC, id) AS i FROM pairs) WHERE i = 1) b USING (row_id)"))
def overlap_best_score(s, d):
    return rounded(intervals.best_overlap(views.windows(s, d), views.observed(s, d)), "fraction", "score")


@query("WITH " + views.SQL["ev"] + " SELECT count(*) AS n, CAST(sum(a.event_id * 7 + b.event_id) AS BIGINT) AS checksum FROM ev a JOIN ev b ON a.contig = b.contig AND a.start < b.start + b.w AND b.start < a.start + a.w WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def interval_pairs(s, d):
    e = views.events(s, d).select("event_id", "event_type", "contig", "start", (F.col("start") + F.col("w")).alias("stop"))
    pairs = intervals.overlap_join(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"))
    return pairs.agg(F.count("*").alias("n"), F.sum(F.col("event_id") * 7 + F.col("r_event_id")).alias("checksum"))


@query(sql("ev acc chip", "SELECT a.row_id, CASE WHEN max(CASE WHEN p.id IS NULL THEN -1 WHEN p.start < a.start + a.summit + 300 AND p.stop > a.start + a.summit - 300 THEN 1 ELSE 0 END) = 1 THEN 1 WHEN max(CASE WHEN p.id IS NULL THEN 0 ELSE 1 END) = 1 THEN 0 ELSE -1 END AS label FROM acc a LEFT JOIN chip p ON a.contig = p.contig AND a.start + a.summit - 2000 < p.stop AND p.start < a.start + a.summit + 2000 GROUP BY a.row_id"))
def radius_class(s, d):
    return intervals.radius_class(views.accessible(s, d), views.observed(s, d))


@query(sql("ev acc cen", "SELECT sample_id, row_id, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY signal_value DESC, row_id) AS i FROM cen) WHERE i <= 20"))
def top_accessible_per_sample(s, d):
    order = [F.desc("signal_value"), F.col("row_id")]
    top = sampling.top_per_group(views.windows(s, d), ["sample_id"], order, 20)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(*order)).cast("long")).select("sample_id", "row_id", "rank")


@query(sql("ev acc cen chip pairs", "SELECT row_id, " + ", ".join(f"coalesce(max(CASE WHEN tf_id = '{t}' THEN CASE WHEN fraction > 0.5 THEN 1 ELSE 0 END END), -1) AS \"{t}\"" for t in ("T0", "T1", "T2", "T3")) + " FROM pairs GROUP BY row_id"))
def label_matrix_pivot(s, d):
    pairs = intervals.overlap_join(views.windows(s, d), views.observed(s, d)).withColumn("label", F.when(intervals.overlap_fraction() > 0.5, 1).otherwise(0)).withColumnRenamed("r_tf_id", "tf_id")
    return labels.matrix(pairs, ["T0", "T1", "T2", "T3"])


@query(sql("ev acc cen chip pairs best labelled", "SELECT row_id, CASE WHEN o <> r THEN -1 ELSE o::INTEGER END AS clean FROM labelled"))
def clean_labels(s, d):
    cen, chip = views.windows(s, d), views.observed(s, d)
    o, r = (intervals.best_overlap(cen, chip.where(F.col("pk_type") == k)).select("row_id", F.col("label").alias(k)) for k in ("optimal", "relaxed"))
    return o.join(r, "row_id").select("row_id", labels.clean_label(F.col("optimal"), F.col("relaxed")).alias("clean"))


@query(sql("ev chip", "SELECT tf_id, sample_id FROM chip GROUP BY 1, 2 HAVING max((pk_type = 'optimal')::INTEGER) = 1 AND max((pk_type = 'relaxed')::INTEGER) = 1"))
def sample_eligibility(s, d):
    files = views.observed(s, d).select("tf_id", F.concat_ws("|", "tf_id", "sample_id").alias("sample_id"), "pk_type")
    both = labels.eligible(files, False).join(labels.eligible(files, True), "sample_id", "left_semi")
    return both.select(F.split("sample_id", r"\|")[0].alias("tf_id"), F.split("sample_id", r"\|")[1].alias("sample_id"))


@query(sql("ev acc", "SELECT row_id, sample_id, contig FROM acc WHERE sample_id IN ('E114', 'E117') AND contig IN ('chr3', 'chr8')"))
def subset_peaks(s, d):
    return labels.subset(views.accessible(s, d), ["E114", "E117"], ["chr3", "chr8"]).select("row_id", "sample_id", "contig")


@query(sql("ev acc", "SELECT row_id, sample_id, contig FROM acc WHERE sample_id NOT IN ('E114', 'E117') AND contig NOT IN ('chr3', 'chr8')"))
def remove_peaks(s, d):
    return labels.remove(views.accessible(s, d), ["E114", "E117"], ["chr3", "chr8"]).select("row_id", "sample_id", "contig")


@query(sql("ev acc", "SELECT CASE WHEN contig IN ('chr8', 'chr9') THEN 'validation' WHEN contig IN ('chr1', 'chr2') THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM acc GROUP BY 1"))
def split_by_contig(s, d):
    return views.accessible(s, d).groupBy(labels.contig_split(F.col("contig")).alias("split")).agg(F.count("*").alias("n"))


@query(sql("ev acc", ", folds AS (SELECT contig, ntile(5) OVER (ORDER BY contig) - 1 AS fold FROM (SELECT DISTINCT contig FROM acc WHERE contig NOT IN ('chr1', 'chr2'))), samples AS (SELECT DISTINCT sample_id FROM acc), roles AS (SELECT f.fold, h.sample_id AS held_out, CASE WHEN a.sample_id = h.sample_id AND c.fold = f.fold THEN 'validation' WHEN a.sample_id <> h.sample_id AND c.fold <> f.fold THEN 'train' END AS role, a.row_id FROM (SELECT DISTINCT fold FROM folds) f CROSS JOIN samples h CROSS JOIN acc a JOIN folds c ON c.contig = a.contig) SELECT CAST(fold AS INTEGER) AS fold, held_out, role, count(*) AS n FROM roles WHERE role IS NOT NULL GROUP BY 1, 2, 3"))
def cv_folds(s, d):
    acc = views.accessible(s, d)
    folds = sampling.folds(acc.where(~F.col("contig").isin(*labels.TEST_CONTIGS)), "contig")
    roles = sampling.cross_validation(acc.select("sample_id").distinct(), folds)
    sizes = acc.groupBy("sample_id", "contig").agg(F.count("*").alias("k"))  # rows meet the fold table as counts
    return sizes.join(roles, ["sample_id", "contig"]).groupBy(F.col("fold").cast("int").alias("fold"), "held_out", "role").agg(F.sum("k").alias("n"))


# -- metrics -----------------------------------------------------------------------------------------------------------

_MWU = "SELECT {k} round(sum(CASE WHEN label = 1 THEN r ELSE 0 END - CASE WHEN label = 1 THEN (np + 1) / 2.0 ELSE 0 END) / (max(np) * max(nn)), 6) AS auroc FROM (SELECT *, rank() OVER ({p} ORDER BY score) + (count(*) OVER (PARTITION BY {q} score) - 1) / 2.0 AS r, sum(label) OVER ({p}) AS np, sum(1 - label) OVER ({p}) AS nn FROM scored){g}"


@query(sql("scored", _MWU.format(k="", p="", q="", g="")))
def auroc(s, d):
    return rounded(metrics.auroc(views.scored(s, d), []), "auroc")


@query(sql("scored", _MWU.format(k="lang,", p="PARTITION BY lang", q="lang,", g=" GROUP BY lang")))
def auroc_by_group(s, d):
    return rounded(metrics.auroc(views.scored(s, d), ["lang"]), "auroc")


_CURVE = "points AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scored GROUP BY 1), cum AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM points WINDOW w AS (ORDER BY score DESC)), curve AS (SELECT score, tp / (tp + fp) AS precision, tp / p AS recall FROM cum)"
views.SQL["curve"] = _CURVE


@query(sql("scored curve", "SELECT round(sum(step), 6) AS auprc FROM (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY score DESC), 0)) * (precision + coalesce(lag(precision) OVER (ORDER BY score DESC), 1)) / 2 AS step FROM curve)"))
def auprc(s, d):
    return rounded(metrics.auprc(views.scored(s, d), []), "auprc")


@query(sql("scored curve", "SELECT " + ", ".join(f"round(coalesce(max(CASE WHEN 1 - precision <= {c} THEN recall END), 0), 6) AS recall_at_{round(100 * c):02d}_fdr" for c in metrics.LEVELS) + " FROM curve"))
def recall_at_fdr(s, d):
    x = metrics.recall_at_fdr(views.scored(s, d), [])
    return rounded(x, *x.columns)


_CONFUSION = "conf AS (SELECT lang, sum(CASE WHEN label = 1 AND score > 1500 THEN 1 ELSE 0 END) AS tp, sum(label) AS p, sum(CASE WHEN label = 0 AND score <= 1500 THEN 1 ELSE 0 END) AS tn, sum(1 - label) AS n, sum(CASE WHEN score > 1500 THEN 1 ELSE 0 END) AS called FROM scored GROUP BY lang)"
views.SQL["conf"] = _CONFUSION


@query(sql("scored conf", "SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(p AS BIGINT) AS p, CAST(tn AS BIGINT) AS tn, CAST(n AS BIGINT) AS n, round(tp / (p + 1e-6), 6) AS positive_accuracy, round(tn / (n + 1e-6), 6) AS negative_accuracy, round((tp / (p + 1e-6) + tn / (n + 1e-6)) / 2, 6) AS balanced_accuracy, round(CASE WHEN p + called > 0 THEN 2.0 * tp / (p + called) ELSE 0 END, 6) AS f1 FROM conf"))
def confusion_f1(s, d):
    return rounded(metrics.confusion(views.scored(s, d), ["lang"], 1500.0), "positive_accuracy", "negative_accuracy", "balanced_accuracy", "f1")


@query(sql("scored conf", "SELECT round(avg((tp / (p + 1e-6) + tn / (n + 1e-6)) / 2), 6) AS balanced_accuracy_mean, round(min((tp / (p + 1e-6) + tn / (n + 1e-6)) / 2), 6) AS balanced_accuracy_min, round(max((tp / (p + 1e-6) + tn / (n + 1e-6)) / 2), 6) AS balanced_accuracy_max FROM conf"))
def fold_roll_up(s, d):
    x = metrics.roll_up(metrics.confusion(views.scored(s, d), ["lang"], 1500.0), ("balanced_accuracy",))
    return rounded(x, *x.columns)


@query(sql("scored", ", x AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -1 ELSE label END AS label, score, (score > 1000)::INTEGER AS called FROM scored), g AS (SELECT t.threshold, sum(CASE WHEN (CASE WHEN label = -1 THEN (score > t.threshold)::INTEGER ELSE label END) = 1 THEN called ELSE 0 END) AS tp, sum(CASE WHEN label = -1 THEN (score > t.threshold)::INTEGER ELSE label END) AS p, sum(called) AS c FROM x CROSS JOIN (VALUES (500.0), (1000.0), (2000.0), (4000.0)) t(threshold) GROUP BY 1) SELECT threshold::DOUBLE AS threshold, round(2.0 * tp / (p + c), 6) AS f1 FROM g WHERE tp > 0 ORDER BY 2.0 * tp / (p + c) DESC, threshold LIMIT 1"))
def threshold_search(s, d):
    x = views.scored(s, d).withColumn("label", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("label"))).withColumn("called", (F.col("score") > 1000).cast("int"))
    return rounded(metrics.best_threshold(x, [500.0, 1000.0, 2000.0, 4000.0]), "f1")


@query(sql("scored", ", x AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -1 ELSE label END AS label, least(score / 10000, 0.99) AS p FROM scored) SELECT round(avg(CASE WHEN label <> -1 THEN (p - label) * (p - label) END), 6) AS mse, round(avg(CASE WHEN label <> -1 THEN -(label * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - label) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))) END), 6) AS cross_entropy, round(-2 * sum(CASE WHEN label = 1 THEN p END) / (sum(CASE WHEN label <> -1 THEN p END) + sum(CASE WHEN label = 1 THEN 1.0 END)), 6) AS f1_loss FROM x"))
def losses(s, d):
    x = views.scored(s, d).select(F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("label")).alias("label"), F.least(F.col("score") / 10000, F.lit(0.99)).alias("p"))
    y, p = F.col("label"), F.col("p")
    return rounded(x.agg(physics.skipped_mse(y, p).alias("mse"), physics.skipped_cross_entropy(y, p).alias("cross_entropy"), physics.expected_f1_loss(y, p).alias("f1_loss")), "mse", "cross_entropy", "f1_loss")


# -- statistics --------------------------------------------------------------------------------------------------------


def _quantile_sql(source: str, keys: str, value: str, probs: tuple[float, ...]) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    cols = []
    for p in probs:
        k, g = f"floor(greatest(1.0, least(n * {p} + 0.4 + 0.2 * {p}, n - 1.0)))", f"greatest(0.0, least(n * {p} + 0.4 + 0.2 * {p} - floor(greatest(1.0, least(n * {p} + 0.4 + 0.2 * {p}, n - 1.0))), 1.0))"
        cols.append(f"round(sum(CASE WHEN i = {k} THEN CASE WHEN n = 1 THEN x ELSE (1 - {g}) * x END WHEN i = {k} + 1 THEN {g} * x ELSE 0 END), 6) AS q{round(p * 100):02d}")
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}{', '.join(cols)} FROM (SELECT {head}{value}::DOUBLE AS x, row_number() OVER ({part} ORDER BY {value}) AS i, count(*) OVER ({part}) AS n FROM {source}){' GROUP BY ' + keys if keys else ''}"


@query(_quantile_sql("events", "event_type", "value", (0.05, 0.5, 0.95)))
def mquantiles(s, d):
    return rounded(stats.quantiles(table(s, d, "events"), ["event_type"], "value", (0.05, 0.5, 0.95)), "q05", "q50", "q95")


@query(_quantile_sql("lineitem", "l_returnflag, l_linestatus", "l_extendedprice", (0.5, 0.9, 0.99)))
def price_quantiles(s, d):
    return rounded(stats.quantiles(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", (0.5, 0.9, 0.99)), "q50", "q90", "q99")


@query("SELECT event_type, round(avg(value), 6) AS upper_mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i <= floor(n * 0.1) + 1 GROUP BY 1")
def upper_rank_mean(s, d):
    return rounded(stats.upper_mean(table(s, d, "events"), ["event_type"], "value", 0.1), "upper_mean")


@query("SELECT l_returnflag, round(corr(a, b), 6) AS spearman FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) GROUP BY 1")
def spearman(s, d):
    return rounded(stats.spearman(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "spearman")


@query("WITH r AS (SELECT c.c_mktsegment, g.k AS parameter, exp(-abs(c.c_acctbal / 1000 - g.k)) AS score, c.c_custkey % 97 AS target FROM customer c CROSS JOIN (VALUES (0.0), (2.0), (5.0)) g(k)), q AS (SELECT c_mktsegment, parameter, corr(a, b) AS spearman FROM (SELECT c_mktsegment, parameter, rank() OVER (PARTITION BY c_mktsegment, parameter ORDER BY score) + (count(*) OVER (PARTITION BY c_mktsegment, parameter, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY c_mktsegment, parameter ORDER BY target) + (count(*) OVER (PARTITION BY c_mktsegment, parameter, target) - 1) / 2.0 AS b FROM r) GROUP BY 1, 2) SELECT c_mktsegment, parameter::DOUBLE AS parameter, round(spearman, 6) AS spearman FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY spearman DESC, parameter) AS i FROM q) WHERE i = 1")
def grid_search(s, d):
    rows = table(s, d, "customer").withColumn("target", F.col("c_custkey") % 97)
    return rounded(stats.grid_best(rows, ["c_mktsegment"], [0.0, 2.0, 5.0], lambda k: F.exp(-F.abs(F.col("c_acctbal") / 1000 - k)), "target"), "spearman")


@query("SELECT event_type, CAST(floor(i * 10 / n) AS BIGINT) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1, 2")
def rank_bins(s, d):
    rows = stats.rank_groups(table(s, d, "events"), ["value", "event_id"], 10, ["event_type"])
    return rounded(rows.groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("SELECT CAST(floor(ln(1 + l_quantity) / 0.5) AS BIGINT) AS a_bin, CAST(floor(ln(1 + l_extendedprice) / 0.5) AS BIGINT) AS b_bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_2d(s, d):
    return stats.histogram_2d(table(s, d, "lineitem"), F.ln(1 + F.col("l_quantity")), F.ln(1 + F.col("l_extendedprice")), 0.5)


_SPLIT = "WITH p AS (SELECT floor(value / 7.0) AS f, value / 7.0 - floor(value / 7.0) AS g FROM events WHERE value IS NOT NULL), h AS (SELECT CAST(bin AS BIGINT) AS bin, sum(w) AS weight FROM (SELECT f AS bin, 1 - g AS w FROM p UNION ALL SELECT f + 1, g FROM p) GROUP BY 1)"


@query(_SPLIT + " SELECT bin, round(weight, 4) AS weight FROM h")
def split_histogram(s, d):
    return rounded(stats.split_histogram(table(s, d, "events").where("value is not null"), "value", 0.0, 7.0), "weight", digits=4)


@query(_SPLIT + ", c AS (SELECT bin, 1 - pow(greatest(0.0, 1 - sum(weight) OVER (ORDER BY bin) / sum(weight) OVER ()), 5) AS cdf FROM h) SELECT bin, round(cdf - coalesce(lag(cdf) OVER (ORDER BY bin), 0), 6) AS weight FROM c")
def minimum_distribution(s, d):
    return rounded(stats.running_minimum_cdf(stats.split_histogram(table(s, d, "events").where("value is not null"), "value", 0.0, 7.0), 5), "weight")


@query("SELECT quality AS label, round(sum(count(*)) OVER () / count(*), 6) AS weight FROM labels GROUP BY 1")
def class_weights(s, d):
    return rounded(stats.class_weights(table(s, d, "labels").select(F.col("quality").alias("label"))), "weight")


@query(sql("scored", "SELECT doc_id, round(o / (1 + o), 6) AS score FROM (SELECT doc_id, (s / (1 - s)) * (0.05 / 0.95) / (0.2 / 0.8) AS o FROM (SELECT doc_id, least(score / 10000, 0.99) AS s FROM scored))"))
def renormalised_scores(s, d):
    return rounded(views.scored(s, d).select("doc_id", stats.renormalised(F.least(F.col("score") / 10000, F.lit(0.99)), F.lit(0.2)).alias("score")), "score")


@query(sql("track", "SELECT vec_id, count(*) AS length, round(avg(v), 6) AS v_mean, round(max(v), 6) AS v_max, round(min(v), 6) AS v_min FROM track GROUP BY 1"))
def region_summaries(s, d):
    return rounded(stats.summaries(views.track(s, d), ["vec_id"], ["v"]), "v_mean", "v_max", "v_min")


# -- sequences ---------------------------------------------------------------------------------------------------------


@query(sql("seqs", "SELECT seq_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM seqs"))
def reverse_complements(s, d):
    return views.sequences(s, d).select("seq_id", sequence.reverse_complement(F.col("seq")).alias("rc"))


_KMERS = "k AS (SELECT substr(seq, CAST(i AS INTEGER) + 1, 6) AS kmer FROM (SELECT seq, unnest(range(length(seq) - 5)) AS i FROM seqs WHERE length(seq) >= 6)), counts AS (SELECT kmer, count(*) AS n FROM (SELECT kmer FROM k UNION ALL SELECT translate(reverse(kmer), 'ACGT', 'TGCA') FROM k) GROUP BY 1)"
views.SQL["kmers"] = _KMERS


@query(sql("seqs kmers", "SELECT kmer, n FROM counts"))
def kmer_counts(s, d):
    return stats.kmer_counts(views.sequences(s, d), 6)


@query(sql("seqs kmers", "SELECT n, kmer FROM counts ORDER BY n DESC, kmer LIMIT 1"))
def consensus_kmer(s, d):
    return stats.consensus_kmer(stats.kmer_counts(views.sequences(s, d), 6))


views.SQL["pos"] = "pos AS (SELECT i AS pos, b AS base, count(*)::DOUBLE AS n FROM (SELECT i, substr(seq, i + 1, 1) AS b FROM (SELECT seq, unnest(range(length(seq)))::INTEGER AS i FROM seqs)) WHERE b <> '' GROUP BY 1, 2)"


@query(sql("seqs pos", "SELECT pos, base, n, round(n / sum(n) OVER (PARTITION BY pos), 6) AS share FROM pos"))
def position_counts(s, d):
    return rounded(stats.position_counts(views.sequences(s, d), None, "seq"), "share")


@query(sql("seqs pos", "SELECT pos, round(-sum(p * ln(p + 1e-6)), 6) AS entropy FROM (SELECT pos, (n + 1) / (sum(n) OVER (PARTITION BY pos) + 4) AS p FROM pos) GROUP BY 1"))
def position_entropy(s, d):
    return rounded(stats.entropy(stats.position_counts(views.sequences(s, d), None, "seq"), ["pos"]), "entropy")


@query(sql("seqs", "SELECT seq_id, " + ", ".join(f"(length(s) - length(replace(s, '{b}', '')))::DOUBLE AS {b.lower()}" for b in "ACGT") + " FROM (SELECT seq_id, seq AS s FROM seqs)"))
def one_hot_sums(s, d):
    coded = views.sequences(s, d).select("seq_id", sequence.one_hot(F.col("seq")).alias("x"))
    return coded.select("seq_id", *(F.aggregate("x", F.lit(0.0), (lambda i: lambda a, r: a + r[i])(i)).alias(b.lower()) for i, b in enumerate("ACGT")))


@query(sql("seqs", "SELECT word, count(*) AS n FROM (SELECT (instr('ACGT', substr(seq, CAST(i AS INTEGER) + 1, 1)) - 1) + 4 * (instr('ACGT', substr(seq, CAST(i AS INTEGER) + 2, 1)) - 1) + 16 * (instr('ACGT', substr(seq, CAST(i AS INTEGER) + 3, 1)) - 1) AS word FROM (SELECT seq, unnest(range(length(seq) - 2)) AS i FROM seqs WHERE length(seq) >= 3)) GROUP BY 1"))
def word_indices(s, d):
    return views.sequences(s, d).select(F.explode(sequence.word_index(F.col("seq"), 3)).alias("word")).withColumn("word", F.col("word").cast("long")).groupBy("word").agg(F.count("*").alias("n"))


@query(sql("seqs", "SELECT word, count(k) AS n FROM (SELECT " + " || ".join(f"substr('ACGT', CAST(i // {4**k} % 4 AS INTEGER) + 1, 1)" for k in (3, 2, 1, 0)) + " AS word FROM (SELECT unnest(range(256)) AS i)) LEFT JOIN (SELECT substr(seq, CAST(i AS INTEGER) + 1, 4) AS k FROM (SELECT seq, unnest(range(length(seq) - 3)) AS i FROM seqs WHERE length(seq) >= 4)) ON k = word GROUP BY 1"))
def all_words(s, d):
    counts = stats.kmer_counts(views.sequences(s, d), 4, both_strands=False).withColumnRenamed("kmer", "word")
    return sequence.all_kmers(s, 4).join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


# -- motifs ------------------------------------------------------------------------------------------------------------


def _scan_sql(matrix, best: str) -> str:
    return f"scan AS (SELECT seq_id, pos, f, {best}(f, r) AS v, {best}(f, r) <> f AS rc FROM (SELECT seq_id, pos, {views.site_sql(matrix)} AS f, {views.site_sql(physics.flipped(matrix))} AS r FROM offsets))"


views.SQL["weights"] = _scan_sql(views.WEIGHTS, "greatest")
views.SQL["energies"] = _scan_sql(views.ENERGIES, "least")


@query(sql("seqs offsets weights", "SELECT count(*) AS n, round(max(v), 4) AS top, round(avg(v), 4) AS mean FROM scan"))
def pwm_scan(s, d):
    x = motif.scan(views.sequences(s, d), views.WEIGHTS)
    return rounded(x.agg(F.count("*").alias("n"), F.max("site_score").alias("top"), F.avg("site_score").alias("mean")), "top", "mean", digits=4)


@query(sql("seqs offsets weights", "SELECT seq_id, round(v, 6) AS site_score, CAST(pos AS INTEGER) AS \"offset\", rc AS is_rc FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY v DESC, pos DESC, rc DESC) AS i FROM scan) WHERE i = 1"))
def pwm_best_site(s, d):
    return rounded(motif.best_site(motif.scan(views.sequences(s, d), views.WEIGHTS).select("seq_id", "offset", "is_rc", "site_score"), ["seq_id"]), "site_score")


@query(sql("seqs offsets energies", "SELECT seq_id, round(min(v), 6) AS energy FROM scan GROUP BY 1"))
def energy_scan_best(s, d):
    return rounded(selex.energies(views.sequences(s, d).where(F.length("seq") >= 8), views.ENERGIES).select("seq_id", "energy"), "energy")


@query(sql("seqs offsets weights", "SELECT a.seq_id, a.mean, a.max, q99, q95, q90, q75, q50 FROM (SELECT seq_id, round(avg(v) / count(*), 6) AS mean, round(max(v), 6) AS max FROM scan GROUP BY 1) a JOIN (" + _quantile_sql("scan", "seq_id", "v", (0.99, 0.95, 0.90, 0.75, 0.50)) + ") b USING (seq_id)"))
def region_scores(s, d):
    scored = motif.scan(views.sequences(s, d), views.WEIGHTS).select("seq_id", "site_score")
    return rounded(motif.region_scores(scored, ["seq_id"]), "mean", "max", "q99", "q95", "q90", "q75", "q50")


@query(sql("seqs offsets weights", "SELECT seq_id, 'ebox' AS motif, round(avg(v), 6) AS mean_score FROM scan GROUP BY 1 UNION ALL SELECT seq_id, 'energy', round(avg(v), 6) FROM (SELECT seq_id, greatest(f, r) AS v FROM (SELECT seq_id, " + views.site_sql(views.ENERGIES) + " AS f, " + views.site_sql(physics.flipped(views.ENERGIES)) + " AS r FROM offsets)) GROUP BY 1"))
def region_motif_matrix(s, d):
    return rounded(motif.mean_scores(views.sequences(s, d), {"ebox": views.WEIGHTS, "energy": views.ENERGIES}, ["seq_id"]), "mean_score")


# -- tracks and physics ------------------------------------------------------------------------------------------------


@query(sql("track", "SELECT vec_id, round(sum(1 / (1 + exp((v - 0.1) / 0.5961))), 6) AS occ, round(1 - exp(sum(ln(1 - 1 / (1 + exp((v + 2) / 0.5961))))), 6) AS bound FROM track GROUP BY 1"))
def occupancies(s, d):
    t = views.track(s, d)
    return rounded(t.groupBy("vec_id").agg(F.sum(physics.occupancy(F.lit(0.1), F.col("v"))).alias("occ"), physics.any_bound(physics.occupancy(F.lit(-2.0), F.col("v"))).alias("bound")), "occ", "bound")


@query(sql("track", "SELECT vec_id, round(max(v) + ln(sum(exp(v - m))), 6) AS lse, round(sum(v * exp(l - v)) / sum(exp(l - v)), 6) AS low FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m, min(v) OVER (PARTITION BY vec_id) AS l FROM track) GROUP BY 1"))
def log_sum_exps(s, d):
    x = F.col("embedding").cast("array<double>")
    return rounded(table(s, d, "embeddings").select("vec_id", physics.log_sum_exp(x).alias("lse"), physics.soft_min(x).alias("low")), "lse", "low")


@query(sql("track", "SELECT vec_id, pos::INTEGER AS pos, round((v - avg(v) OVER (PARTITION BY vec_id)) / stddev_pop(v) OVER (PARTITION BY vec_id), 5) AS z FROM track"))
def z_score_track(s, d):
    return rounded(coverage.z_scores(views.track(s, d), ["vec_id"], "v").select("vec_id", "pos", "z"), "z", digits=5)


@query(sql("track", "SELECT vec_id, w AS \"window\", round(max(v), 6) AS v FROM (SELECT vec_id, v, unnest(range(CAST(greatest(0, floor((pos - 8) / 4.0) + 1) AS BIGINT), CAST(floor(pos / 4.0) AS BIGINT) + 1)) AS w FROM track) GROUP BY 1, 2"))
def max_pooling(s, d):
    return rounded(coverage.max_pooled(views.track(s, d), ["vec_id"], "v", 8, 4), "v")


_COVER = "cover AS (SELECT contig, pos, count(*) / 101.0 AS cov FROM (SELECT contig, unnest(range(b, b + 100)) AS pos FROM (SELECT contig, CASE WHEN strand = '+' THEN pos ELSE aend - 100 END AS b FROM reads)) GROUP BY 1, 2)"
views.SQL["cover"] = _COVER


@query(sql("ev reads cover", "SELECT contig, count(*) AS positions, round(sum(cov), 4) AS total, round(max(cov), 6) AS top FROM cover GROUP BY 1"))
def read_coverage(s, d):
    c = coverage.fragment_coverage(views.reads(s, d), 100, ["contig"])
    return rounded(rounded(c.groupBy("contig").agg(F.count("*").alias("positions"), F.sum("cov").alias("total"), F.max("cov").alias("top")), "total", digits=4), "top")


@query(sql("ev reads cover", "SELECT contig, round(max(1e6 * cov / s), 4) AS top, round(sum(ln(1 + cov)), 4) AS log_total FROM (SELECT contig, cov, sum(cov) OVER (PARTITION BY contig) AS s FROM cover) GROUP BY 1"))
def normalised_coverage(s, d):
    c = coverage.fragment_coverage(views.reads(s, d), 100, ["contig"])
    n = coverage.normalised(c.withColumn("raw", F.col("cov")), ["contig"])
    return rounded(n.groupBy("contig").agg(F.max("cov").alias("top"), F.sum(coverage.log_accessibility(F.col("raw"))).alias("log_total")), "top", "log_total", digits=4)


@query(sql("track", ", k AS (SELECT i - 9 AS d, 1 - abs(2 * i / 19.0 - 1) AS w FROM (SELECT unnest(range(20)) AS i)), s AS (SELECT t.vec_id, t.pos + k.d AS pos, sum(abs(t.v) * k.w) AS v FROM track t CROSS JOIN k GROUP BY 1, 2) SELECT vec_id, pos::BIGINT AS pos, round(v / (sum(v) OVER (PARTITION BY vec_id) + 1e-6), 6) AS cov FROM s WHERE pos BETWEEN 0 AND 63"))
def smoothed_track(s, d):
    t = views.track(s, d).select("vec_id", F.col("pos").cast("long").alias("pos"), F.abs("v").alias("cov"))
    return rounded(coverage.smoothed(t, ["vec_id"], 10), "cov")


@query(sql("track", "SELECT vec_id, c::DOUBLE AS c, round(avg(o), 6) AS occ_mean, round(max(o), 6) AS occ_max FROM (SELECT vec_id, c, 1 / (1 + exp(-(ln(c) - v / 0.5961))) * abs(v) AS o FROM track CROSS JOIN (VALUES (0.01), (0.1), (1.0)) t(c)) GROUP BY 1, 2"))
def concentration_occupancy(s, d):
    t = views.track(s, d).select("vec_id", F.col("v").alias("energy"), F.abs("v").alias("weight"))
    return rounded(coverage.concentration_occupancy(t, ["vec_id"], [0.01, 0.1, 1.0], physics.RT), "occ_mean", "occ_max")


@query(sql("track", "SELECT vec_id, pos::INTEGER AS pos, round(v / m, 6) AS weight FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m, row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS i FROM (SELECT vec_id, pos, abs(v) AS v FROM track)) WHERE i > 9"))
def access_weights(s, d):
    return rounded(coverage.weights(views.track(s, d).select("vec_id", "pos", F.abs("v").alias("cov")), ["vec_id"], 8).select("vec_id", "pos", "weight"), "weight")


# -- catalogue queries -------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_join(s, d):
    return catalog.natural_join(table(s, d, "nation").withColumnRenamed("n_regionkey", "key"), table(s, d, "region").withColumnRenamed("r_regionkey", "key")).select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def natural_left_join(s, d):
    c = table(s, d, "customer").select("c_custkey")
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return catalog.natural_join(c, o, "left")


@query("SELECT r_name, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY 1")
def three_way_join(s, d):
    t = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(t.groupBy("r_name").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("total")), "total", digits=2)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_in(s, d):
    return catalog.missing(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS \"values\" FROM nation GROUP BY 1")
def array_aggregate(s, d):
    return in_text(catalog.listed(table(s, d, "nation"), ["n_regionkey"], "n_name"), "values")


@query("SELECT c_mktsegment, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS matches, count(DISTINCT c_nationkey)::INTEGER AS n FROM customer GROUP BY 1")
def one_or_list(s, d):
    rows = table(s, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return in_text(catalog.one_or_list(rows, ["c_mktsegment"], "c_nationkey"), "matches")


@query("SELECT id, name FROM (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 10) UNION ALL SELECT min(s_suppkey + 100), n FROM (SELECT s_suppkey, 'N' || s_nationkey AS n FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5) WHERE n NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 10) GROUP BY n")
def find_or_insert(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    new = table(s, d, "supplier").select((F.col("s_suppkey") + 100).alias("id"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("name")).unionByName(n.where("id < 5").withColumn("id", F.col("id") + 100))
    return catalog.find_or_insert(n.where("id < 10"), new, ["name"]).select("id", "name")


@query("WITH a AS (SELECT s_nationkey AS k, min(s_suppkey) AS f FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1), b AS (SELECT c_nationkey AS k, min(c_custkey) AS f FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1), c AS (SELECT c_nationkey AS k, min(c_custkey) AS f FROM (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) GROUP BY 1) SELECT n_nationkey AS k, coalesce(a.f, b.f, c.f) AS found FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey")
def fallback_match(s, d):
    c = table(s, d, "customer")
    steps = [table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("found")), c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("found")), c.groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("found"))]
    return catalog.by_fallback(table(s, d, "nation").select(F.col("n_nationkey").alias("k")), steps, "k", "found")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS i FROM orders) WHERE i = 1")
def prefer_first(s, d):
    return catalog.first_by(table(s, d, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT s_nationkey AS tf_id, s_name AS name, 'supplier' AS source FROM supplier UNION ALL SELECT c_nationkey, c_name, 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def prefer_source(s, d):
    a = table(s, d, "supplier").select(F.col("s_nationkey").alias("tf_id"), F.col("s_name").alias("name"), F.lit("supplier").alias("source"))
    return motif.prefer(a, table(s, d, "customer").select(F.col("c_nationkey").alias("tf_id"), F.col("c_name").alias("name"), F.lit("customer").alias("source")))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) AND p_size IN (10, 11, 12, 13, 14, 15, 16, 17, 18, 19)")
def optional_filters(s, d):
    p = table(s, d, "part")
    first = p.join(F.broadcast(p.agg(F.min("p_brand").alias("p_brand"))), "p_brand", "left_semi")  # one row
    return catalog.where_all(first, p_size=list(range(10, 20)), p_type=None).select("p_partkey", "p_brand", "p_size")


@query("SELECT 'except' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def set_operations(s, d):
    c, p = table(s, d, "customer"), table(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    count = lambda left, kind: catalog.set_operation(left.select("c_nationkey"), p, kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("op"), "n")
    return count(c, "except").unionByName(count(c, "intersect")).unionByName(count(c, "union")).unionByName(count(c, "all"))


@query("SELECT n_regionkey, string_agg(urls, ';' ORDER BY role) AS matrix FROM (SELECT n_regionkey, n_nationkey % 2 AS role, string_agg(n_name, ',' ORDER BY n_name) AS urls FROM nation GROUP BY 1, 2) GROUP BY 1")
def url_matrix(s, d):
    return catalog.url_matrix(table(s, d, "nation").select("n_regionkey", (F.col("n_nationkey") % 2).alias("role"), F.col("n_name").alias("url")), ["n_regionkey"])


@query("SELECT a.o_orderkey AS r1, b.o_orderkey AS r2 FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0")
def paired_files(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).alias("paired_with"), (F.col("o_orderkey") % 2 + 1).alias("paired_end"))
    return catalog.mates(o)


@query("SELECT p_partkey, replace(replace(p_type, ' ', '__'), '/', '-') || '.' || replace(p_name, ' ', '__') || '.' || p_size || '.bed' AS name FROM part")
def file_names(s, d):
    return table(s, d, "part").select("p_partkey", catalog.file_name(F.replace("p_type", F.lit(" "), F.lit("__")), F.col("p_name"), F.col("p_size").cast("string"), F.lit("bed")).alias("name"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT props) AS kinds FROM events GROUP BY 1")
def event_properties(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("props").alias("kinds"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, len(regexp_extract_all(url, '[0-9]+'))::INTEGER AS numbers FROM pages")
def url_patterns(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.size(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).alias("numbers"))


# -- sampling ----------------------------------------------------------------------------------------------------------

_DRAW = "('0x' || substr(md5('0:' || doc_id), 1, 15))::BIGINT"


@query(f"SELECT doc_id, quality AS label FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) AS i, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS m FROM labels) WHERE i <= m")
def balanced_sample(s, d):
    return sampling.balanced(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(f"SELECT doc_id, quality AS label, (row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) - 1) % 5 AS fold FROM labels")
def stratified_folds(s, d):
    return sampling.stratified(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").withColumn("fold", F.col("fold").cast("long"))


@query(sql("ev acc", "SELECT sample_id, CAST(floor((i - 1) / 64) AS BIGINT) AS batch, count(*) AS n FROM (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY row_id) AS i FROM acc) GROUP BY 1, 2"))
def batches(s, d):
    return sampling.batches(views.accessible(s, d), ["row_id"], ["sample_id"], 64).groupBy("sample_id", "batch").agg(F.count("*").alias("n"))


@query(sql("ev acc", ", c AS (SELECT sample_id, count(*) AS n FROM acc GROUP BY 1), b AS (SELECT sample_id, CAST(floor(200 * n / sum(n) OVER ()) AS BIGINT) AS base FROM c) SELECT sample_id, base + CASE WHEN row_number() OVER (ORDER BY sample_id) <= 200 - sum(base) OVER () THEN 1 ELSE 0 END AS n_batch FROM b"))
def batch_allocation(s, d):
    return sampling.allocation(views.accessible(s, d).groupBy("sample_id").agg(F.count("*").alias("n")), 200)


@query(sql("ev acc", "SELECT sample_id, split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM (SELECT sample_id, row_id, CASE WHEN row_number() OVER (PARTITION BY sample_id ORDER BY start, row_id) <= floor(count(*) OVER (PARTITION BY sample_id) * 0.75) THEN 'train' ELSE 'validation' END AS split FROM acc) GROUP BY 1, 2"))
def head_tail(s, d):
    return sampling.head_tail(views.accessible(s, d), ["start", "row_id"], 0.75, ["sample_id"]).groupBy("sample_id", "split").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(sql("ev acc", "SELECT sample_id, row_id FROM (SELECT sample_id, row_id, row_number() OVER (PARTITION BY sample_id ORDER BY row_id) AS i FROM acc) WHERE (i - 1) % 5 = 0"))
def every_fifth(s, d):
    return sampling.every_nth(views.accessible(s, d), ["row_id"], ["sample_id"]).select("sample_id", "row_id")


@query("WITH r AS (SELECT s_suppkey, s_acctbal + 1000 AS w, sum(s_acctbal + 1000) OVER () AS t, sum(s_acctbal + 1000) OVER (ORDER BY s_suppkey) AS c FROM supplier) SELECT s_suppkey, CAST(floor(c / t * 250 + 0.5) - floor(c / t * 250 - w / t * 250 + 0.5) AS INTEGER) AS copies FROM r WHERE floor(c / t * 250 + 0.5) - floor(c / t * 250 - w / t * 250 + 0.5) > 0")
def weighted_resample(s, d):
    return sampling.resampled(table(s, d, "supplier").withColumn("w", F.col("s_acctbal") + 1000), "s_suppkey", "w", 250).select("s_suppkey", "copies")


# -- lookups and programs ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def point_lookup(s, d):
    return catalog.where_all(table(s, d, "orders"), o_orderkey=42).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation WHERE upper(n_name) IN (SELECT upper(n_name) FROM nation WHERE n_nationkey IN (1, 5, 7))")
def upper_name_lookup(s, d):
    n = table(s, d, "nation").withColumn("name", F.upper("n_name"))
    return n.join(catalog.where_all(n, n_nationkey=[1, 5, 7]).select("name").distinct(), "name", "left_semi").select("n_nationkey", "name")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
def missing_files(s, d):
    o = table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return catalog.natural_join(table(s, d, "customer").select("c_custkey"), o, "left").where("o_orderkey is null").select("c_custkey")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_names(s, d):
    return table(s, d, "part").select("p_brand", "p_size").distinct()


@query(sql("ev acc cen chip", "SELECT row_id, " + ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM chip p WHERE p.contig = c.contig AND c.start < p.stop AND p.start < c.stop AND p.pk_type = '{k}') THEN 1 ELSE 0 END AS {k}" for k in ("optimal", "relaxed")) + " FROM cen c"))
def region_overlap_matrix(s, d):
    chip = views.observed(s, d)
    return programs.matrix_of_regions(views.windows(s, d), {k: chip.where(F.col("pk_type") == k) for k in ("optimal", "relaxed")})


@query(sql("ev acc cen chip", ", ok AS (SELECT sample_id FROM chip GROUP BY 1 HAVING max((pk_type = 'relaxed')::INTEGER) = 1), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY signal_value DESC, row_id) AS i FROM cen WHERE sample_id IN (SELECT sample_id FROM ok)) WHERE i <= 200), hits AS (SELECT t.row_id, p.tf_id, max(CASE WHEN p.pk_type = 'optimal' AND (least(t.stop, p.stop) - greatest(t.start, p.start)) / (p.stop - p.start)::DOUBLE > 0.5 THEN 1 ELSE 0 END) AS o, max(CASE WHEN p.pk_type = 'relaxed' AND (least(t.stop, p.stop) - greatest(t.start, p.start)) / (p.stop - p.start)::DOUBLE > 0.5 THEN 1 ELSE 0 END) AS r FROM top t JOIN chip p ON p.contig = t.contig AND p.sample_id = t.sample_id AND t.start < p.stop AND p.start < t.stop GROUP BY 1, 2) SELECT t.row_id, t.sample_id, " + ", ".join(f"coalesce(max(CASE WHEN tf_id = '{k}' THEN CASE WHEN o = 1 THEN 1 WHEN r = 1 THEN -1 ELSE 0 END END), 0) AS \"{k}\"" for k in ("T0", "T1", "T2", "T3")) + " FROM top t LEFT JOIN hits h USING (row_id) GROUP BY 1, 2"))
def sample_dataset(s, d):
    tfs = ["T0", "T1", "T2", "T3"]
    return programs.sample_dataset(views.windows(s, d), views.observed(s, d), tfs, n_peaks=200).select("row_id", "sample_id", *tfs)


@query(sql("ev acc reads cover", "SELECT a.row_id, a.stop - a.start AS length, round(coalesce(sum(c.cov), 0) / (a.stop - a.start), 6) AS cov_mean, round(coalesce(max(c.cov), 0), 6) AS cov_max FROM acc a LEFT JOIN cover c ON c.contig = a.contig AND c.pos >= a.start AND c.pos < a.stop GROUP BY 1, 2, a.stop, a.start"))
def region_coverage(s, d):
    return rounded(programs.region_summary(views.accessible(s, d), views.reads(s, d), 100), "cov_mean", "cov_max")


@query(sql("track", "SELECT vec_id, mu, round(cost, 5) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, mu) AS i FROM (SELECT vec_id, mu::DOUBLE AS mu, sum(-ln(1 / (1 + exp((v - mu) / 0.5961)) + 1e-12) * abs(v)) AS cost FROM track CROSS JOIN (VALUES (-1.0), (0.0), (1.0)) t(mu) GROUP BY 1, 2)) WHERE i = 1"))
def best_affinity(s, d):
    t = views.track(s, d).select("vec_id", F.col("v").alias("energy"), F.abs("v").alias("cov"))
    return rounded(programs.best_affinity(t, [-1.0, 0.0, 1.0], ["vec_id"]), "cost", digits=5)


@query("SELECT s_suppkey, count(*) AS n FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) JOIN (SELECT unnest(range(250)) AS k) ON k % n = i GROUP BY 1")
def upsampled_rows(s, d):
    return programs.upsampled(table(s, d, "supplier"), 250, "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("SELECT cut, round(corr(a, b), 6) AS spearman FROM (SELECT cut, rank() OVER (PARTITION BY cut ORDER BY p_size) + (count(*) OVER (PARTITION BY cut, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY cut ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY cut, p_retailprice) - 1) / 2.0 AS b FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM part) JOIN (VALUES (50), (100), (200)) t(cut) ON i <= cut) GROUP BY 1")
def rank_curve(s, d):
    return rounded(programs.rank_curve(table(s, d, "part"), ["p_partkey"], [50, 100, 200], "p_size", "p_retailprice"), "spearman")


# -- models: no SQL form --------------------------------------------------------------------------------


@query()
def forest_evaluation(s, d):
    rows = views.scored(s, d).withColumnRenamed("score", "n_chars").withColumn("f2", (F.col("doc_id") % 7).cast("double"))
    found = models.forest_scores(rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0"), ["n_chars", "f2"], depth=5, trees=10)
    return rounded(metrics.auroc(found, []), "auroc")


@query()
def boosted_trees(s, d):
    rows = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 11).cast("double").alias("f2"), F.col("p_retailprice").alias("y"))
    return rounded(models.boosted_correlation(rows.where("p_partkey % 4 <> 0"), rows.where("p_partkey % 4 = 0"), ["size", "f2"], "y", rounds=5), "spearman")


@query(sql("seqs offsets lowest rounds", "SELECT round, count(*) AS n, round(avg(e), 6) AS mean_energy FROM lowest JOIN rounds USING (seq_id) GROUP BY 1"))
def selex_rounds(s, d):
    seqs = fit_queries.in_rounds(s, d)
    scored = selex.energies(seqs.where("length(seq) >= 8"), views.ENERGIES).join(seqs.select("seq_id", "round"), "seq_id")
    return rounded(scored.groupBy("round").agg(F.count("*").alias("n"), F.avg("energy").alias("mean_energy")), "mean_energy")


@query(sql("seqs", "SELECT seq_id, (seq_id * 7) % (length(seq) - 5) AS at, substr(seq, 1, CAST((seq_id * 7) % (length(seq) - 5) AS INTEGER)) || 'CACGTG' || substr(seq, CAST((seq_id * 7) % (length(seq) - 5) + 7 AS INTEGER)) AS seq FROM seqs WHERE length(seq) >= 6"))
def embedded_motifs(s, d):
    seqs = views.sequences(s, d).where("length(seq) >= 6")
    return selex.embedded(seqs, "CACGTG", F.pmod(F.col("seq_id") * 7, F.length("seq") - 5))
