"""Edge cases of the operators on hand-made tables."""

import math
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifloom import streaming
from motifloom.functions import physics, sequence
from motifloom.operators import catalog, coverage, intervals, labels, metrics, motif, sampling, selex, stats
from motifloom.plans import catalogue


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- intervals ---------------------------------------------------------------------------------------------------------


def test_centred_drops_starts_at_zero(spark):
    df = frame(spark, [("c", 0, 500, 250), ("c", 1, 501, 250), ("c", 5, 100, 10)], "contig string, start long, stop long, summit long")
    assert [(r["start"], r["stop"], r["summit"]) for r in intervals.centred(df, 250).collect()] == [(1, 501, 250)]


def test_touching_intervals_do_not_overlap(spark):
    a = frame(spark, [(1, "c", 0, 10), (2, "c", 10, 20), (3, "d", 0, 10), (4, "c", 600, 3000)], "row_id long, contig string, start long, stop long")
    b = frame(spark, [("c", 10, 12), ("c", 500, 2000)], "contig string, start long, stop long")
    assert sorted((r["row_id"], r["r_start"]) for r in intervals.overlap_join(a, b).collect()) == [(2, 10), (4, 500)]
    assert {r["row_id"]: r["r_start"] for r in intervals.overlap_join(a, b, how="left").collect()} == {1: None, 2: 10, 3: None, 4: 500}


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(i, rng.choice("ab"), s := rng.randrange(5000), s + rng.choice([1, 50, 700, 3000])) for i in range(n)]
    a, b = make(120), make(120)
    schema = "row_id long, contig string, start long, stop long"
    found = sorted((r["row_id"], r["r_row_id"]) for r in intervals.overlap_join(frame(spark, a, schema), frame(spark, b, schema), bin_width=64).collect())
    assert found == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])


def test_fraction_of_one_half_is_no_label(spark):
    r = frame(spark, [(1, "c", 0, 100), (2, "c", 200, 300), (3, "e", 0, 9)], "row_id long, contig string, start long, stop long")
    o = frame(spark, [(1, "c", 50, 150, 7.0), (2, "c", 200, 240, 5.0), (3, "c", 260, 300, 6.0)], "id long, contig string, start long, stop long, score double")
    got = {x["row_id"]: (x["fraction"], x["label"], x["score"]) for x in intervals.best_overlap(r, o).collect()}
    assert got == {1: (0.5, 0, 0.0), 2: (1.0, 1, 5.0), 3: (0.0, 0, 0.0)}


@pytest.mark.parametrize(("regions", "lengths"), [(25, 40), (3, 40), (25, 3)])
def test_best_overlap_equals_brute_force(spark, regions, lengths):
    """Long, short and few lengths; regions across blocks; ties by id; nulls and another contig's intervals do not count."""
    rng = random.Random(regions * lengths)
    place = lambda n, most: (rng.choice("ab"), s := rng.randrange(-20, 180), s + rng.randint(1, most))
    a, b = [(i, *place(i, regions)) for i in range(150)], [(i, *place(i, lengths), rng.random()) for i in range(200)]
    r = frame(spark, [*a, (900, None, 1, 9), (901, "z", 1, 9)], "row_id long, contig string, start long, stop long")
    o = frame(spark, [*b, (900, None, 1, 9, 1.0)], "id long, contig string, start long, stop long, score double")
    got = {x["row_id"]: (x["fraction"], x["label"], x["score"]) for x in intervals.best_overlap(r, o, block_width=64).collect()}
    assert got.pop(900) == got.pop(901) == (0.0, 0, 0.0)
    for i, contig, start, stop in a:
        pairs = [((min(stop, t) - max(start, s)) / (t - s), -j, score) for j, c, s, t, score in b if c == contig and s < stop and start < t]
        fraction, _, score = max(pairs, default=(0.0, 0, 0.0))
        assert got[i] == (fraction, int(fraction > 0.5), score if fraction > 0.5 else 0.0)


@pytest.mark.parametrize("uniform", [True, False])
def test_best_of_a_block_by_pairs_and_by_lengths(uniform):
    rng = np.random.default_rng(7)
    a = np.unique(np.column_stack([rng.integers(0, 80, 60), rng.integers(1, 40, 60)]), axis=0)
    rows = pa.table({"start": a[:, 0], "stop": a.sum(1), "order": rng.permutation(len(a)), "score": a[:, 0] * 1.0})
    observed = intervals.Observed(rows)
    start = rng.integers(-10, 90, 200)
    stop = start + (12 if uniform else rng.integers(1, 30, 200))
    x = np.maximum((np.minimum(stop[:, None], observed.stop) - np.maximum(start[:, None], observed.start)) / observed.length, 0)
    everything = np.zeros(200, int), np.full(200, len(a))
    for fraction, best in (observed._by_pairs(start, stop, *everything), observed._by_lengths(start, stop), observed.best(start, stop)):
        assert fraction.tolist() == x.max(1).tolist()
        assert best[fraction > 0].tolist() == x.argmax(1)[fraction > 0].tolist()


#: Queries that need the best interval only.
WITHOUT_PAIRS = [
    "overlap_best_score",
    "peak_labels",
    "imputed_labels",
    "unambiguous_labels",
    "clean_labels",
    "peak_label_counts",
]


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_no_pairs_of_intervals_are_listed(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "r_contig" not in plan and "MapInArrow" in plan


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Events repeated 2 and 24 times by shifted keys; copies of an interval begin at one place and differ in length."""
    place = tmp_path_factory.mktemp("copies")
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    for n in (2, 24):
        again = e.crossJoin(spark.range(n).withColumnRenamed("id", "i"))
        again.withColumns({"event_id": F.col("event_id") + F.col("i") * 100003, "user_id": F.col("user_id") + F.col("i") * 1501}).drop("i").write.parquet(f"{place}/{n}/events.parquet")
    return place


def most_rows(node):
    """The rows that the largest step of a plan that ran has put out."""
    name, rows = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
    below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return max([rows.get().value() if rows.isDefined() else 0, *map(most_rows, below)])


#: Queries whose steps are measured on copies.
LINEAR = [
    "peak_labels",
    "imputed_labels",
    "unambiguous_labels",
    "clean_labels",
    "peak_label_counts",
]


@pytest.mark.parametrize("name", LINEAR)
def test_no_step_grows_faster_than_the_input(spark, copies, name):
    most = {}
    for n in (2, 24):
        df = catalogue.queries()[name](spark, f"{copies}/{n}")
        columns = sorted(df.columns)
        df = df.select(*columns)
        got = sorted(map(tuple, df.collect()))
        most[n] = most_rows(df._jdf.queryExecution().executedPlan())
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW events AS FROM '{copies}/{n}/events.parquet/*.parquet'")
        assert got == sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    assert 0 < most[24] <= 12 * most[2]


def test_fetch_clips_and_spans_chunks(spark):
    genome = frame(spark, [("c", 0, "ACGT"), ("c", 1, "TTGG"), ("c", 2, "CA")], "contig string, chunk long, seq string")
    r = frame(spark, [(1, "c", 2, 6), (2, "c", 8, 20), (3, "c", 0, 4)], "row_id long, contig string, start long, stop long")
    assert {x["row_id"]: x["seq"] for x in intervals.fetch(genome, r, chunk=4).collect()} == {1: "GTTT", 2: "CA", 3: "ACGT"}


def test_uniform_width(spark):
    df = frame(spark, [(0, 5), (7, 12)], "start long, stop long")
    assert intervals.uniform_width(df) == 5
    with pytest.raises(ValueError):
        intervals.uniform_width(df.unionByName(frame(spark, [(0, 6)], "start long, stop long")))


# -- labels ------------------------------------------------------------------------------------------------------------


def test_combined_labels(spark):
    rows = [(1, "optimal", 1, 5.0), (1, "relaxed", 1, 9.0), (2, "optimal", 0, 0.0), (2, "relaxed", 1, 3.0), (3, "relaxed", 0, 0.0)]
    got = {r["row_id"]: (r["label"], r["score"]) for r in labels.combine(frame(spark, rows, "row_id long, pk_type string, label int, score double")).collect()}
    assert got == {1: (1, 5.0), 2: (-1, 3.0), 3: (0, 0.0)}


def test_label_helpers(spark):
    df = frame(spark, [(0,), (-1,), (1,)], "label int")
    assert [r[0] for r in df.select(labels.from_legacy(F.col("label"))).collect()] == [-1, 0, 1]
    assert [r[0] for r in df.select(labels.imputed(F.col("label"), F.lit(0.7), 0.5)).collect()] == [0, 1, 1]
    with pytest.raises(Exception, match="not a label"):
        frame(spark, [("2,1",)], "t string").select(labels.merged_label(F.col("t"))).collect()
    with pytest.raises(ValueError):
        labels.by_contig(df, include=["a"], exclude=["b"])


# -- sequences ---------------------------------------------------------------------------------------------------------


def one(spark, column, value):
    return frame(spark, [(value,)], "s string").select(column).first()[0]


def test_sequence_functions(spark):
    s = F.col("s")
    assert one(spark, sequence.reverse_complement(s), "AACGTN") == "NACGTT"
    assert one(spark, sequence.kmers(s, 3), "acgt") == ["ACG", "CGT", "ACG", "CGT"]
    assert one(spark, sequence.kmers(s, 5), "ACG") == []
    assert one(spark, sequence.kmers(s, 2), None) == []
    assert one(spark, sequence.kmers(s, 2, both_strands=False), "a\n\U0001f9ecNa") == ["A\n", "\n\U0001f9ec", "\U0001f9ecN", "NA"]
    assert one(spark, sequence.one_hot(s, 4), "aR?") == [[1, 0, 0, 0], [0.5, 0, 0.5, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    assert one(spark, sequence.one_hot_window(s, 2), "ACG") == [[0.25] * 4] * 2
    assert one(spark, sequence.word_index(s, 2), "TAN") == [3, None]
    assert one(spark, sequence.flip(sequence.one_hot(s)), "AC") == one(spark, sequence.one_hot(s), "GT")
    left, n, right = sequence.split_primer(s)
    assert frame(spark, [("TCCATC20NTGCA",)], "s string").select(left, n, right).first()[:] == ("TCCATC", 20, "TGCA")
    assert one(spark, sequence.with_flanks(s, F.lit("GAT"), F.lit("C"), 2), "TT") == "ATTTCN"
    assert one(spark, F.length(sequence.random_sequence(s, 30)), "k") == 30


@pytest.mark.parametrize("n", [7, 8, 127, 128, 135, 136, 400])
def test_scan_over_pieces(spark, n):
    rng = random.Random(n)
    seq = "".join(rng.choice("ACGTN") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(n))
    m = np.random.default_rng(n).normal(size=(8, 4)).round(3)
    got = {r["offset"]: r for r in motif.scan(frame(spark, [(1, seq)], "seq_id long, seq string"), m, unknown=2.0).collect()}
    assert sorted(got) == list(range(max(0, n - 7)))
    for o, r in got.items():
        w = seq[o : o + 8]
        if "N" in w:
            assert r["site_score"] == 2.0 and not r["is_rc"]
            continue
        score = lambda a: sum(a[i]["ACGT".index(b)] for i, b in enumerate(w))  # noqa: B023, E731
        f, c = score(m), score(m[::-1, ::-1])
        assert r["site_score"] == pytest.approx(max(f, c)) and r["is_rc"] == (c > f)


def test_words_of_a_long_sequence_take_seconds(spark):
    """Time follows the length: with a substring for each word 300,000 bases took minutes."""
    words = spark.createDataFrame([("ACGTT" * 60_000,)], "s string").select(F.explode(sequence.kmers(F.col("s"), 5)).alias("w"))
    start = time.time()
    counts = {r["w"]: r["count"] for r in words.groupBy("w").count().collect()}
    assert time.time() - start < 15
    assert len(counts) == 10 and counts["ACGTT"] == counts["AACGT"] == 60_000 and sum(counts.values()) == 2 * (300_000 - 4)


def test_scans_of_lower_case_and_unknown_bases(spark):
    """Repeat-masked bases count; a window with N stands at its middle with 0.25 L, or has the mean energy."""
    m = np.arange(12.0).reshape(3, 4)
    df = frame(spark, [(1, "acgTNAc")], "seq_id long, seq string")
    upper = frame(spark, [(1, "ACGT")], "seq_id long, seq string")
    row = lambda x: sorted((r["offset"], r["is_rc"], r["site_score"]) for r in x.collect())
    assert row(motif.scan(df, m))[:2] == row(motif.scan(upper, m))
    assert row(motif.weight_scan(df, m)) == sorted(row(motif.scan(upper, m)) + [(3, False, 0.75), (4, False, 0.75), (5, False, 0.75)])
    wide = {"": m, "wide": np.arange(20.0).reshape(5, 4)}
    got = motif.scan(frame(spark, [(1, "ACGTNACGT")], "seq_id long, seq string"), wide, unknown=9.0, centre_unknown=True)
    assert {n: sorted(r["offset"] for r in got.where(F.col("motif") == n).where("site_score = 9").collect()) for n in wide} == {"": [3, 4, 5], "wide": [2, 3, 4, 5, 6]}
    plan = motif.weight_scan(df, m).agg(F.sum("offset"))._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in plan and "RLIKE" not in plan  # no walk through the sequence for every offset
    model = physics.EnergyModel(m, -3.0, 7.0)
    assert row(motif.energy_scan(df, model)) == [(o, rc, s - 3.0) for o, rc, s in row(motif.scan(upper, m, lowest=True))] + [(o, False, 7.0) for o in (2, 3, 4)]
    with pytest.raises(Exception, match="shorter"):
        selex.energies(frame(spark, [(1, "AC")], "seq_id long, seq string"), m).collect()


def test_long_sequences_are_cut(spark, monkeypatch):
    monkeypatch.setattr(motif, "PIECE", 16)
    monkeypatch.setattr(motif, "CHUNK", 40)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ACGTacgtN") for _ in range(rng.randrange(60)))) for i in range(20)] + [(99, None)]
    m = {"a": np.random.default_rng(1).normal(size=(5, 4)), "b": np.random.default_rng(2).normal(size=(5, 4))}
    got = {(r["seq_id"], r["motif"], r["offset"]): r["site_score"] for r in motif.scan(frame(spark, rows, "seq_id long, seq string"), m).collect()}
    want = {}
    for i, seq in rows:
        for name, a in m.items():
            for o in range(len(seq or "") - 4):
                w = seq[o : o + 5].upper()
                score = lambda x: sum(x[k]["ACGT".index(b)] for k, b in enumerate(w))  # noqa: B023, E731
                want[i, name, o] = None if "N" in w else pytest.approx(max(score(a), score(a[::-1, ::-1])))
    assert got == want


def test_palindromes_count_twice(spark):
    got = {r["kmer"]: r["n"] for r in stats.kmer_counts(frame(spark, [("ATAT",)], "seq string"), 4).collect()}
    assert got == {"ATAT": 2}


def test_same_length_scan(spark):
    rows = motif.same_length_scan(frame(spark, [("ACGTA",)], "seq string"), np.eye(4)).collect()
    assert len(rows) == 5 and max(r["fwd"] for r in rows) == 4.0


# -- statistics and metrics --------------------------------------------------------------------------------------------


def test_quantile_of_one_value(spark):
    assert stats.quantiles(frame(spark, [(3.5,)], "x double"), [], "x", (0.5,)).first()[0] == 3.5


def test_quantiles_equal_the_formula(spark):
    x = sorted(random.Random(3).uniform(0, 9) for _ in range(37))
    got = stats.quantiles(frame(spark, [(v,) for v in x], "x double"), [], "x", (0.05, 0.5, 0.95)).first()
    for p, v in zip((0.05, 0.5, 0.95), got):
        h = len(x) * p + 0.4 + 0.2 * p
        k = int(min(max(h, 1), len(x) - 1))
        g = min(max(h - k, 0), 1)
        assert v == pytest.approx((1 - g) * x[k - 1] + g * x[k])


SCORED = "label int, score double"


def test_metrics_on_ties_and_single_classes(spark):
    tied = frame(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (-1, 0.9)], SCORED)
    assert metrics.auroc(tied, []).first()[0] == 0.5
    assert math.isnan(metrics.auroc(frame(spark, [(1, 0.1), (1, 0.2)], SCORED), []).first()[0])
    perfect = frame(spark, [(1, 0.9), (1, 0.8), (0, 0.1)], SCORED)
    assert metrics.auprc(perfect, []).first()[0] == 1.0
    assert metrics.recall_at_fdr(frame(spark, [(0, 0.9), (1, 0.1)], SCORED), []).first()["recall_at_05_fdr"] == 0.0
    assert metrics.recall_at_fdr(frame(spark, [(0, 0.9), (1, 0.1)], SCORED), []).first()["recall_at_50_fdr"] == 1.0
    assert metrics.confusion(frame(spark, [(-1, 0.4)], SCORED), []).count() in (0, 1)
    called = tied.withColumn("called", F.lit(0))
    assert metrics.best_threshold(called, [0.1, 0.5]).count() == 0


def test_mean_skipping_nan(spark):
    assert metrics.mean_skipping_nan(frame(spark, [(1.0,), (float("nan"),)], "x double"), "x").first()[0] == 0.5


# -- sampling ----------------------------------------------------------------------------------------------------------


def test_folds_need_values(spark):
    with pytest.raises(ValueError):
        sampling.folds(frame(spark, [("a",), ("b",)], "contig string"), "contig")
    got = {r["contig"]: r["fold"] for r in sampling.folds(frame(spark, [(c,) for c in "gfedcba"], "contig string"), "contig").collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2, "f": 3, "g": 4}


def test_draws(spark):
    df = frame(spark, [(i, int(i < 5)) for i in range(30)], "id long, label int")
    assert {r["label"]: r["count"] for r in sampling.balanced(df, "id").groupBy("label").count().collect()} == {0: 5, 1: 5}
    assert {r["label"]: r["count"] for r in sampling.with_replacement(df, "id", 40).groupBy("label").count().collect()} == {0: 20, 1: 20}
    got = sampling.resampled(df.withColumn("w", F.col("label").cast("double")), "id", "w", 20).collect()
    assert sum(r["copies"] for r in got) == 20 and {r["id"] for r in got} == set(range(5))
    assert [r["n_batch"] for r in sampling.allocation(frame(spark, [("a", 1), ("b", 1), ("c", 1)], "sample_id string, n long"), 10).orderBy("sample_id").collect()] == [4, 3, 3]


# -- catalogue ---------------------------------------------------------------------------------------------------------


def test_not_in_and_nulls(spark):
    left = frame(spark, [(1,), (2,)], "k int")
    assert [r[0] for r in catalog.missing(left, frame(spark, [(1,)], "k int"), "k").collect()] == [2]
    assert catalog.missing(left, frame(spark, [(1,), (None,)], "k int"), "k").count() == 0


def test_selectors():
    assert catalog.exactly_one(a=None, b=[1]) == ("b", [1])
    for bad in ({"a": None, "b": None}, {"a": 1, "b": 2}):
        with pytest.raises(ValueError):
            catalog.exactly_one(**bad)


def test_small_catalogue_helpers(spark):
    files = frame(spark, [("e", "f1", 1, "f2"), ("e", "f2", 2, "f1"), ("e", "f3", 1, "f9")], "exp string, file_id string, paired_end int, paired_with string")
    assert [tuple(r) for r in catalog.mates(files).collect()] == [("f1", "f2")]
    refs = frame(spark, [(["UniProtKB:P1", "X:2"],)], "x array<string>")
    assert refs.select(catalog.uniprot_ids(F.col("x"))).first()[0] == ["P1"]
    assert one(spark, catalog.gene_ids(F.col("s")), "ENSG00000000002 ENSG00000000001 ENSG00000000002") == ["ENSG00000000001", "ENSG00000000002"]
    assert catalog.clean_header("File accession (new)") == "File_accession_new"
    with pytest.raises(Exception, match="unknown type"):
        one(spark, catalog.peak_type(F.col("s")), "odd")
    taken, left = catalog.claim(frame(spark, [(i,) for i in range(5)], "task_id int"), 2)
    assert (taken.count(), left.count()) == (2, 3)


# -- energies and fits -------------------------------------------------------------------------------------------------


def test_physics(spark):
    mu, e = F.lit(-1.0), F.col("e")
    df = frame(spark, [(-2.0,), (0.0,), (50.0,)], "e double")
    for r in df.select("e", physics.occupancy(mu, e).alias("o"), physics.log_occupancy(mu, e).alias("l")).collect():
        assert math.log(r["o"]) == pytest.approx(r["l"], abs=1e-6)
    pwm = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7]])
    model = physics.energies_of_pwm(pwm)
    en = model.ddg
    assert en.min() == 0 and en.mean(1).sum() == pytest.approx(3.0) and (model.consensus, model.mean) == (-5.0, -2.0)
    assert physics.energies_of_pwm(np.tile(pwm, (2, 1))).ddg.mean(1).sum() == pytest.approx(6.0)
    zero, base = physics.zeroed(en + 1.0)
    assert base == pytest.approx(2.0) and physics.energy_range(zero)[0] == 0 and physics.consensus(zero) == "AT"
    ref, diff = physics.differences(model)
    assert ref == pytest.approx(model.consensus + en[:, 0].sum()) and diff.shape == (3, 2)
    again = physics.updated(physics.contributions(diff), ref)
    assert np.allclose(again.ddg, en) and again.consensus == pytest.approx(model.consensus) and again.mean == pytest.approx(again.consensus + en.mean())
    assert "Consensus: AT" in physics.summary(model)
    assert (physics.flipped(physics.flipped(en)) == en).all()


def test_fit_finds_an_enriched_word(spark):
    seqs = selex.embed(150, 20, "CACGTG", spark, seed=1).drop("at")
    background = selex.pool(spark, 300, 20, seed=9)
    ddg, history = selex.fit(seqs, background, 6, rounds=3)
    assert physics.consensus(ddg) == "CACGTG" and max(history) >= history[0]
    assert selex.extension_side(seqs, ddg).count() == 6


def test_coverage_counts_fragments_once(spark):
    reads = frame(spark, [("c", 10, 46, "+"), ("c", 10, 46, "+"), ("c", 0, 15, "-")], "contig string, pos long, aend long, strand string")
    got = {r["pos"]: r["cov"] for r in coverage.fragment_coverage(reads, 4, ["contig"]).collect()}
    assert got == {10: 0.4, **{11: 0.6, 12: 0.6, 13: 0.6, 14: 0.2}}


# -- streaming ---------------------------------------------------------------------------------------------------------


def test_stream_equals_batch(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        src.write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(src.schema).parquet(f"{folder}/in")
        q = streaming.windowed_counts(stream, width="1 day").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{folder}/c").start()
        q.processAllAvailable()
        q.stop()
        got = spark.table("counts").agg(F.sum("n"), F.count("*")).first()
    want = streaming.windowed_counts(src, width="1 day").agg(F.sum("n"), F.count("*")).first()
    assert got == want


# -- programs ----------------------------------------------------------------------------------------------------------


def test_features_and_folds(spark):
    from motifloom.plans import programs

    rng = random.Random(6)
    genome = frame(spark, [(f"chr{c}", k, "".join(rng.choice("ACGT") for _ in range(64))) for c in range(1, 9) for k in range(8)], "contig string, chunk long, seq string")
    windows = frame(spark, [(c * 100 + i, f"chr{c}", i * 9, i * 9 + 60, rng.randrange(2)) for c in range(1, 9) for i in range(1, 40)], "row_id long, contig string, start long, stop long, label int")
    m = np.random.default_rng(1).normal(size=(6, 4))
    table = programs.tf_feature_table(windows, genome, {"a": m, "b": -m}, chunk=64)
    assert table.columns == ["row_id", "a", "b"] and table.count() == windows.count()
    result = programs.cross_validate(windows.join(table, "row_id"), ["a", "b"], depth=3, trees=3)
    assert result.count() == 5
    feats = programs.motif_features(windows, intervals.fetch(genome, windows, chunk=64), m, balance=True)
    assert {r["count"] for r in feats.groupBy("label").count().collect()} == {min(r["count"] for r in windows.groupBy("label").count().collect())}


def test_small_program_helpers(spark):
    from motifloom.plans import programs

    seqs = frame(spark, [(i, 1, "ACGT") for i in range(7)], "seq_id long, round int, seq string")
    assert programs.topped_up(seqs, seqs.limit(2), spark, 4, 5).count() == 7
    assert programs.upsampled(seqs, 3).count() == 3 and programs.upsampled(seqs, 16).count() == 16
    pairs = programs.zipped(frame(spark, [(2, "b"), (1, "a")], "i int, x string"), frame(spark, [(9, "z"), (8, "y")], "j int, y string"), "i", "j")
    assert sorted((r["x"], r["y"]) for r in pairs.collect()) == [("a", "y"), ("b", "z")]


def test_words_with_other_letters_are_counted(spark):
    import collections

    seqs = ["ACGTNACGTRR", "", None, "AC", "acgtacgt", "é" * 5 + "ACG", "ACG" * 1000]
    want = collections.Counter(s.upper()[i : i + 3] for s in seqs if s for i in range(len(s) - 2))
    got = {r["kmer"]: r["n"] for r in stats.kmer_counts(frame(spark, [(s,) for s in seqs], "seq string"), 3, both_strands=False).collect()}
    assert got == want
    long = {r["kmer"]: r["n"] for r in stats.kmer_counts(frame(spark, [("ACGT" * 10,), ("ACGT" * 9,)], "seq string"), 31, both_strands=False).collect()}
    assert sum(long.values()) == 10 + 6 and all(len(k) == 31 for k in long)
    with pytest.raises(ValueError):
        stats.kmer_counts(frame(spark, [("A",)], "seq string"), 32)


def test_ambiguous_labels_are_imputed_by_calls(spark):
    from motifloom.plans import programs

    clean = [(0.9, 1, 50.0)] * 10 + [(0.1, 0, 1.0)] * 10
    ambiguous = [(0.8, -1, 30.0 + i) for i in range(5)] + [(0.2, -1, 10.0 + i) for i in range(5)]  # called where peaks are high
    rows = frame(spark, clean + ambiguous, "score double, label int, peak double")
    got = sorted((r["peak"], r["label"]) for r in programs.with_imputed(rows, "peak").collect() if r["peak"] not in (50.0, 1.0))
    assert got == [(10.0 + i, 0) for i in range(5)] + [(30.0 + i, 1) for i in range(5)]
    none = frame(spark, [(0.1, -1, 3.0), (0.2, 0, 1.0)], "score double, label int, peak double")  # nothing is called
    assert sorted(r["label"] for r in programs.with_imputed(none, "peak").collect()) == [-1, 0]


def test_folds_with_imputed_labels(spark):
    from motifloom.plans import programs

    rng = random.Random(3)
    rows = [(i, f"chr{3 + i % 10}", float(x), -1 if rng.random() < 0.3 else int(x > 0.5), 100 * x + rng.random()) for i, x in enumerate(rng.random() for _ in range(400))]
    df = frame(spark, rows, "row_id long, contig string, f double, label int, peak double")
    plain, imputed = (programs.cross_validate(df, ["f"], 2, peak_score=p, depth=3, trees=5).collect() for p in (None, "peak"))
    assert len(plain) == len(imputed) == 2
    assert sum(r["p"] + r["n"] for r in imputed) > sum(r["p"] + r["n"] for r in plain)  # ambiguous rows count as well
