"""Queries on sequences, regions, labels and energies, beside those of ``catalogue``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motifloom.functions import physics, sequence
from motifloom.operators import intervals, labels, metrics, motif, sampling, stats
from motifloom.plans import programs, views
from motifloom.plans.registry import query, rounded
from motifloom.plans.views import site_sql, sql, table

MODEL = physics.energies_of_pwm(views.SHARES)
CHUNK = 1024

views.SQL["masked"] = "masked AS (SELECT seq_id, upper(seq) AS seq, pos FROM (SELECT seq_id, seq, unnest(range(length(seq) - 7)) AS pos FROM (SELECT doc_id AS seq_id, regexp_replace(lower(text), '[^acgtn]', '', 'g') AS seq FROM documents) WHERE length(seq) >= 8))"
views.SQL["spots"] = "spots AS (SELECT e.event_id AS row_id, s.seq_id, substr(s.seq, CAST(e.event_id * 7919 % length(s.seq) + 1 AS INTEGER), 50) AS part FROM events e JOIN seqs s ON s.seq_id = e.user_id WHERE length(s.seq) > 0)"
views.SQL["sites"] = f"sites AS (SELECT seq_id, seq, pos, f, r FROM (SELECT seq_id, seq, pos, {site_sql(views.WEIGHTS)} AS f, {site_sql(physics.flipped(views.WEIGHTS))} AS r FROM offsets))"


def masked(s, d):
    """Lower-case sequences in which n stands for an unknown base."""
    return table(s, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.lower("text"), "[^acgtn]+", "").alias("seq"))


def genome(s, d):
    """The documents' sequences as a genome of chunks."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.substr("seq", i + 1, F.lit(CHUNK)))
    return views.sequences(s, d).select(F.col("seq_id").alias("contig"), F.posexplode(pieces).alias("chunk", "seq")).where("seq <> ''")


def places(s, d):
    """Fifty bases from a place anywhere in a sequence, for every event."""
    lengths = views.sequences(s, d).select(F.col("seq_id").alias("contig"), F.length("seq").alias("length")).where("length > 0")
    start = F.col("event_id") * 7919 % F.col("length")
    events = table(s, d, "events").select(F.col("event_id"), F.col("user_id").alias("contig")).join(lengths, "contig")
    return events.select(F.col("event_id").alias("row_id"), "contig", start.alias("start"), (start + 50).alias("stop"))


def spots(s, d):
    return intervals.fetch(genome(s, d), places(s, d), chunk=CHUNK)


_N = "instr(substr(seq, CAST(pos AS INTEGER) + 1, 8), 'N') > 0"


@query(sql("masked", f"SELECT count(*) AS n, CAST(sum(is_rc::INTEGER) AS BIGINT) AS n_rc, CAST(sum(o) AS BIGINT) AS offsets, round(avg(v), 4) AS mean, round(max(v), 4) AS top FROM (SELECT CASE WHEN {_N} THEN 2.0 ELSE greatest(f, r) END AS v, NOT {_N} AND r > f AS is_rc, pos + CASE WHEN {_N} THEN 4 ELSE 0 END AS o FROM (SELECT seq, pos, {site_sql(views.WEIGHTS)} AS f, {site_sql(physics.flipped(views.WEIGHTS))} AS r FROM masked))"))
def masked_weight_scan(s, d):
    x = motif.weight_scan(masked(s, d), views.WEIGHTS)
    return rounded(x.agg(F.count("*").alias("n"), F.sum(F.col("is_rc").cast("long")).alias("n_rc"), F.sum("offset").alias("offsets"), F.avg("site_score").alias("mean"), F.max("site_score").alias("top")), "mean", "top", digits=4)


@query(sql("masked", f"SELECT count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS low, count(*) FILTER (v = {MODEL.mean!r}) AS unknown FROM (SELECT CASE WHEN {_N} THEN {MODEL.mean!r} ELSE {MODEL.consensus!r} + least(f, r) END AS v FROM (SELECT seq, pos, {site_sql(MODEL.ddg)} AS f, {site_sql(physics.flipped(MODEL.ddg))} AS r FROM masked))"))
def masked_energy_scan(s, d):
    x = motif.energy_scan(masked(s, d), MODEL)
    return rounded(x.agg(F.count("*").alias("n"), F.avg("site_score").alias("mean"), F.min("site_score").alias("low"), F.sum((F.col("site_score") == MODEL.mean).cast("long")).alias("unknown")), "mean", "low", digits=4)


_SHARES = ", ".join(f"avg((substr(seq, CAST(pos AS INTEGER) + 1, 1) = '{b}')::INTEGER) AS {b.lower()}" for b in "ACGT")


@query(sql("seqs", f", p AS (SELECT pos, {_SHARES} FROM seqs CROSS JOIN (SELECT unnest(range(8)) AS pos) WHERE length(seq) >= 8 GROUP BY 1), l AS (SELECT pos, -ln((5e-4 + 0.999 * a) / (1 - (5e-4 + 0.999 * a))) AS a, -ln((5e-4 + 0.999 * c) / (1 - (5e-4 + 0.999 * c))) AS c, -ln((5e-4 + 0.999 * g) / (1 - (5e-4 + 0.999 * g))) AS g, -ln((5e-4 + 0.999 * t) / (1 - (5e-4 + 0.999 * t))) AS t FROM p), z AS (SELECT pos, a - least(a, c, g, t) AS a, c - least(a, c, g, t) AS c, g - least(a, c, g, t) AS g, t - least(a, c, g, t) AS t FROM l), k AS (SELECT 1.5 * count(*) / sum((a + c + g + t) / 4) AS k, -2 - 1.5 * count(*) AS consensus FROM z) SELECT CAST(pos AS INTEGER) AS pos, round(a * k, 6) AS a, round(c * k, 6) AS c, round(g * k, 6) AS g, round(t * k, 6) AS t, round(consensus::DOUBLE, 6) AS consensus FROM z, k"))
def energy_model(s, d):
    """Of the bases that sequences begin with."""
    words = views.sequences(s, d).where("length(seq) >= 8").select(F.substring("seq", 1, 8).alias("site"))
    shares = np.zeros((8, 4))
    for r in stats.position_counts(words, 8).collect():  # a matrix
        shares[r["pos"], "ACGT".index(r["base"])] = r["share"]
    model = physics.energies_of_pwm(shares)
    rows = [(i, *map(float, r), model.consensus) for i, r in enumerate(model.ddg)]
    return rounded(s.createDataFrame(rows, "pos int, a double, c double, g double, t double, consensus double"), "a", "c", "g", "t", "consensus")


@query(sql("seqs spots", "SELECT row_id, part AS seq FROM spots"))
def genome_fetch(s, d):
    return spots(s, d)


@query(sql("seqs spots", "SELECT row_id, " + ", ".join(f"CASE WHEN length(part) = 50 THEN (50 - length(replace(part, '{b}', '')))::DOUBLE ELSE 12.5 END AS {b.lower()}" for b in "ACGT") + " FROM spots"))
def window_codes(s, d):
    x = spots(s, d).select("row_id", sequence.one_hot_window(F.col("seq"), 50).alias("x"))
    return x.select("row_id", *(F.aggregate("x", F.lit(0.0), (lambda i: lambda a, r: a + r[i])(i)).alias(b) for i, b in enumerate("acgt")))


@query(sql("seqs spots", "SELECT row_id, CASE WHEN length(part) < 50 THEN -1 ELSE instr('TGCA', right(part, 1)) - 1 END AS first, CASE WHEN length(part) < 50 THEN -1 ELSE instr('TGCA', left(part, 1)) - 1 END AS last FROM spots"))
def flipped_codes(s, d):
    x = spots(s, d).select("row_id", sequence.flip(sequence.one_hot_window(F.col("seq"), 50)).alias("x"))
    return x.select("row_id", *((F.array_position(F.col("x")[i], F.lit(1.0).cast("float")) - 1).cast("long").alias(n) for i, n in ((0, "first"), (49, "last"))))


@query(sql("seqs", "SELECT kmer, count(*) AS n FROM (SELECT unnest([k, translate(reverse(k), 'ACGT', 'TGCA')]) AS kmer FROM (SELECT substr(seq, CAST(i AS INTEGER) + 1, 5) AS k FROM (SELECT seq, unnest(range(length(seq) - 4)) AS i FROM seqs WHERE length(seq) >= 5))) GROUP BY 1"))
def enumerated_kmers(s, d):
    forward = views.sequences(s, d).select(F.explode(sequence.kmers(F.col("seq"), 5, both_strands=False)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    strands = F.explode(F.array("kmer", sequence.reverse_complement(F.col("kmer"))))  # the other strand's words are these mirrored
    return forward.select(strands.alias("kmer"), "n").groupBy("kmer").agg(F.sum("n").alias("n"))


@query("SELECT CASE WHEN c IN ('A', 'a') THEN 0 WHEN c IN ('C', 'c') THEN 1 WHEN c IN ('G', 'g') THEN 2 WHEN c IN ('T', 't') THEN 3 ELSE -1 END AS i, count(*) AS n FROM (SELECT unnest(regexp_extract_all(p_name, '.')) AS c FROM part) GROUP BY 1")
def base_indices(s, d):
    chars = table(s, d, "part").select(F.explode(F.split("p_name", "")).alias("c")).where("c <> ''")
    return chars.groupBy(sequence.base_index(F.col("c")).alias("i")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'ACGT' AS l, CAST(p_size AS INTEGER) AS n, upper(p_name) AS r FROM part")
def primer_parts(s, d):
    left, n, right = sequence.split_primer(F.concat(F.lit("ACGT"), F.col("p_size").cast("string"), F.lit("N"), F.upper("p_name")))
    return table(s, d, "part").select("p_partkey", left.alias("l"), n.alias("n"), right.alias("r"))


@query(sql("seqs", f"SELECT seq_id, count(*) AS n, round(sum(f), 4) AS fwd, round(max(r), 4) AS rc FROM (SELECT seq_id, {site_sql(views.WEIGHTS).replace(' END', ' ELSE 0 END')} AS f, {site_sql(physics.flipped(views.WEIGHTS)).replace(' END', ' ELSE 0 END')} AS r FROM (SELECT seq_id, 'NNN' || seq || 'NNNN' AS seq, unnest(range(length(seq))) AS pos FROM seqs)) GROUP BY 1"))
def same_length_scan(s, d):
    x = motif.same_length_scan(views.sequences(s, d), views.WEIGHTS)
    return rounded(x.groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("fwd").alias("fwd"), F.max("rc").alias("rc")), "fwd", "rc", digits=4)


@query(sql("seqs offsets sites", "SELECT base, count(*) AS n FROM (SELECT substr(seq, CAST(pos AS INTEGER), 1) AS base FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY greatest(f, r) DESC, pos DESC, r > f DESC) AS i FROM sites) WHERE i = 1 AND pos > 0) GROUP BY 1"))
def flanking_bases(s, d):
    seqs = views.sequences(s, d)
    best = motif.best_site(motif.scan(seqs, views.WEIGHTS).select("seq_id", "offset", "is_rc", "site_score"), ["seq_id"])
    return stats.flanking_bases(best.join(seqs, "seq_id"), -1)


@query(sql("seqs spots", f"SELECT row_id, round(max(greatest(f, r)), 6) AS ebox, round(max(greatest(g, h)), 6) AS energy FROM (SELECT row_id, {site_sql(views.WEIGHTS)} AS f, {site_sql(physics.flipped(views.WEIGHTS))} AS r, {site_sql(views.ENERGIES)} AS g, {site_sql(physics.flipped(views.ENERGIES))} AS h FROM (SELECT row_id, part AS seq, unnest(range(43)) AS pos FROM spots WHERE length(part) = 50)) GROUP BY 1"))
def motif_features(s, d):
    return rounded(programs.tf_feature_table(places(s, d), genome(s, d), {"ebox": views.WEIGHTS, "energy": views.ENERGIES}, chunk=CHUNK), "ebox", "energy")


# -- regions and labels ------------------------------------------------------------------------------------------------


@query(sql("ev acc", "SELECT row_id, start + summit - 800 AS lo, start + summit + 800 AS hi FROM acc"))
def window_bounds(s, d):
    lo, hi = intervals.window(F.col("start"), F.col("summit"), 800)
    return views.accessible(s, d).select("row_id", lo.alias("lo"), hi.alias("hi"))


@query(sql("ev acc", "SELECT row_id, greatest(0, start - 4000) AS lo, stop + 4000 AS hi FROM acc"))
def padded_regions(s, d):
    lo, hi = intervals.padded(F.col("start"), F.col("stop"), 2000)
    return views.accessible(s, d).select("row_id", lo.alias("lo"), hi.alias("hi"))


def _labelled(s, d):
    from motifloom.plans.catalogue import labelled

    return labelled(s, d)


@query(sql("ev acc cen chip pairs best labelled final", "SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM final WHERE label <> -1 GROUP BY 1"))
def unambiguous_labels(s, d):
    return labels.unambiguous(_labelled(s, d)).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query(sql("ev acc cen chip pairs best labelled final", "SELECT row_id, CAST(CASE WHEN label = -1 THEN CASE WHEN score > 30 THEN 1 ELSE 0 END ELSE label END AS INTEGER) AS label FROM final"))
def imputed_labels(s, d):
    return _labelled(s, d).select("row_id", labels.imputed(F.col("label"), F.col("score"), 30.0).cast("int").alias("label"))


@query(sql("ev acc", "SELECT 'in' AS part, row_id FROM acc WHERE contig IN ('chr3', 'chr8') UNION ALL SELECT 'out', row_id FROM acc WHERE contig NOT IN ('chr3', 'chr8')"))
def contig_subsets(s, d):
    acc = views.accessible(s, d)
    part = lambda name, **x: labels.by_contig(acc, **x).select(F.lit(name).alias("part"), "row_id")
    return part("in", include=["chr3", "chr8"]).unionByName(part("out", exclude=["chr3", "chr8"]))


@query(sql("ev acc", "SELECT sample_id, row_id FROM (SELECT sample_id, row_id, row_number() OVER (PARTITION BY sample_id ORDER BY row_id) - 1 AS i FROM acc) WHERE i >= 10 AND i < 200 AND (i - 10) % 3 = 0"))
def positional_rows(s, d):
    return labels.positional(views.accessible(s, d), ["row_id"], 10, 200, 3, ["sample_id"]).select("sample_id", "row_id")


@query("SELECT l.doc_id, CAST(CASE WHEN d.lang = 'en' THEN l.toxic - l.quality ELSE l.quality END AS INTEGER) AS label FROM labels l JOIN documents d USING (doc_id)")
def merged_labels(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    text = F.concat_ws(",", F.when(F.col("lang") == "en", F.col("toxic") - F.col("quality")).otherwise(F.col("quality")).cast("string"), F.lit("9"))
    return rows.select("doc_id", labels.merged_label(text).alias("label"))


@query(sql("ev acc", "SELECT row_id, rpad(sample_id || '_' || contig || '_' || start, 30, ' ') AS id FROM acc"))
def region_ids(s, d):
    return views.accessible(s, d).select("row_id", labels.region_id(F.col("sample_id"), F.col("contig"), F.col("start").cast("string")).alias("id"))


@query("SELECT p_partkey, p_brand AS factor FROM part")
def factor_names(s, d):
    return table(s, d, "part").select("p_partkey", labels.factor_name(F.concat(F.lit("eGFP-"), F.col("p_brand"))).alias("factor"))


_SCORES = ", t AS (SELECT * FROM scored)"


@query(sql("scored", ", x AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -1 ELSE label END AS label, score, (score > 1000)::INTEGER AS called FROM scored), o AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM x WHERE label = -1), g AS (SELECT turn, sum(CASE WHEN i = greatest(1.0, least(k, n - 1.0)) THEN (1 - f) * score WHEN i = greatest(1.0, least(k, n - 1.0)) + 1 THEN f * score ELSE 0 END) AS threshold FROM (SELECT turn, score, i, n, floor(n * turn / 8.0 + 0.4 + 0.2 * turn / 8.0) AS k, greatest(0.0, least(1.0, n * turn / 8.0 + 0.4 + 0.2 * turn / 8.0 - greatest(1.0, least(floor(n * turn / 8.0 + 0.4 + 0.2 * turn / 8.0), n - 1.0)))) AS f FROM o CROSS JOIN (SELECT unnest(range(8)) AS turn)) GROUP BY 1), h AS (SELECT turn, threshold, sum(CASE WHEN y = 1 THEN called ELSE 0 END) AS tp, sum(y) AS p, sum(called) AS c FROM (SELECT g.turn, g.threshold, x.called, CASE WHEN x.label = -1 THEN (x.score > g.threshold)::INTEGER ELSE x.label END AS y FROM x CROSS JOIN g) GROUP BY 1, 2) SELECT round(threshold, 4) AS threshold, round(2.0 * tp / (p + c), 6) AS f1 FROM h WHERE tp > 0 ORDER BY 2.0 * tp / (p + c) DESC, turn LIMIT 1"))
def threshold_of_quantiles(s, d):
    x = views.scored(s, d).withColumn("label", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("label"))).withColumn("called", (F.col("score") > 1000).cast("int"))
    return rounded(rounded(metrics.best_threshold(x, metrics.threshold_grid(x, 9)), "f1"), "threshold", digits=4)


@query("SELECT round(sum(CASE WHEN value > 100 THEN 0 ELSE value END) / count(*), 6) AS mean FROM events")
def mean_without_nan(s, d):
    return rounded(metrics.mean_skipping_nan(table(s, d, "events").select(F.when(F.col("value") > 100, float("nan")).otherwise(F.col("value")).alias("x")), "x"), "mean")


# -- tracks ------------------------------------------------------------------------------------------------------------


@query(sql("track", "SELECT vec_id, round(sum(-ln(1 + exp((v * 40 - 0.1) / 0.5961))), 3) AS log_occ, round(sum(ln(p) - ln(1 - p)), 4) AS logits, round(sum(1 / (1 + exp(-(0.3 + 0.1 + abs(v) - v)))), 6) AS site FROM (SELECT *, 1 / (1 + exp(-v)) AS p FROM track) GROUP BY 1"))
def log_occupancies(s, d):
    t, v = views.track(s, d), F.col("v")
    log_occ = F.sum(physics.log_occupancy(F.lit(0.1), v * 40)).alias("log_occ")
    from motifloom.operators.coverage import site_occupancy

    site = F.sum(site_occupancy(v, F.lit(0.3), F.abs(v), F.lit(0.1))).alias("site")
    return rounded(rounded(rounded(t.groupBy("vec_id").agg(log_occ, F.sum(physics.logit(physics.logistic(v))).alias("logits"), site), "log_occ", digits=3), "logits", digits=4), "site")


_AFF = ", k AS (SELECT i AS d, (CASE WHEN i <= 3.5 THEN 2.0 * i / 7 ELSE 2 - 2.0 * i / 7 END) AS w FROM (SELECT unnest(range(8)) AS i)), kk AS (SELECT d, w / sum(w) OVER () AS w FROM k), r AS (SELECT vec_id, pos, v AS score, abs(v) AS access, v * v AS cov, row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS i FROM track), q AS (SELECT *, access / max(access) OVER (PARTITION BY vec_id) AS weight FROM r WHERE i > 9), o AS (SELECT vec_id, pos, cov, c::DOUBLE AS c, 1 / (1 + exp(-(-c + score / 0.5961))) * weight AS occ FROM q CROSS JOIN (SELECT unnest(range(5)) AS c)), h AS (SELECT *, occ / sum(occ) OVER (PARTITION BY vec_id, c) AS share FROM o), m AS (SELECT vec_id, c, pos + d - 3 AS pos, sum(share * w) AS smooth FROM h CROSS JOIN kk GROUP BY 1, 2, 3), t AS (SELECT vec_id, c, -sum(ln(m.smooth + 1e-12) * h.cov) AS cost FROM h JOIN m USING (vec_id, c, pos) GROUP BY 1, 2) SELECT vec_id, -c AS affinity, round(cost, 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, c) AS i FROM t) WHERE i = 1"


@query(sql("track", _AFF))
def chemical_affinity(s, d):
    v = F.col("v")
    sites = views.track(s, d).select("vec_id", "pos", v.alias("score"), F.abs(v).alias("access"), (v * v).alias("cov"))
    return rounded(programs.chemical_affinity(sites, ["vec_id"], 4, 5, 8), "cost", digits=4)


# -- draws -------------------------------------------------------------------------------------------------------------


@query(sql("ev acc", "SELECT 'top' AS kind, sample_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY signal_value DESC, start, row_id) AS i FROM acc) WHERE i <= 30 UNION ALL SELECT 'drawn', sample_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ('0x' || substr(md5('4:' || row_id), 1, 15))::BIGINT, row_id) AS i FROM acc) WHERE i <= 30"))
def ranked_peaks(s, d):
    acc = views.accessible(s, d)
    part = lambda kind, **x: sampling.by_rank(acc, ["sample_id"], "row_id", 30, **x).select(F.lit(kind).alias("kind"), "sample_id", "row_id")
    return part("top").unionByName(part("drawn", use_top=False, seed=4))


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('0:' || doc_id), 1, 15))::BIGINT, doc_id) AS i, count(*) OVER (PARTITION BY quality) AS m FROM labels), t AS (SELECT quality, m, unnest(range(100)) AS draw_id FROM (SELECT DISTINCT quality, m FROM r)), u AS (SELECT quality, draw_id, ('0x' || substr(md5('1:' || quality || ':' || draw_id), 1, 15))::BIGINT % m + 1 AS i FROM t) SELECT u.quality AS label, u.draw_id::INTEGER AS draw_id, r.doc_id FROM u JOIN r ON r.quality = u.quality AND r.i = u.i")
def drawn_with_replacement(s, d):
    return sampling.with_replacement(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", 200).select("label", "draw_id", "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('3:' || doc_id), 1, 15))::BIGINT, doc_id) AS place FROM documents")
def shuffled_places(s, d):
    from motifloom.operators.ordered import numbered

    rows = table(s, d, "documents").select("doc_id", sampling.draw(F.col("doc_id"), 3).alias("draw"))
    return numbered(rows, [], ["draw", "doc_id"]).select("doc_id", F.col("row_upto").alias("place"))
