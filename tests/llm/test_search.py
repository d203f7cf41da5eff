"""Collocations, lexical search and adaptive search against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from motifloom.llm import adaptive_search, collocations, lexical_search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n long, phrase string, id string, f int"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with odd rows, and columns whose names the operators use themselves."""
    real = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "A b. A B\x0bÉ É", None), (1003, " \t\n", "de"), (None, "of the of the OF THE", "und"), (1004, "x y z " * 20_000, "fr"), (1005, "q" * 30_000, "fr"), (1006, "a\x00b  c d e", None), real[0], real[0]]
    return spark.createDataFrame([(i, t, s, -1, "p", "i", 7) for i, t, s in real + odd], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 11 ----------------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top=2000, percent=80, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        good = {g: k for g, k in own.items() if k >= least}
        longer = defaultdict(int)
        for g, k in good.items():
            for m in range(2, len(g)):
                for s in range(len(g) - m + 1):
                    longer[g[s : s + m]] = max(longer[g[s : s + m]], k)
        found = []
        for g, a in good.items():
            if len(g) > 1 and not (longer[g] and 100 * longer[g] >= percent * a):
                score, k = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), a, own[g[:k]], own[g[k:]], score))
        out += [(lang, i + 1, p.decode(), a, l, r, n[lang], score) for i, (_, _, p, a, l, r, score) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"heavy_limit": 300, "automaton_limit": 200}, {"bits": 12}, {"bits": 9, "heavy_limit": 1 << 30}])
def test_collocations(docs, empty, options):
    found = collocations.mine(docs, min_count=5, top=150, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, found.collect()))
    assert got == plain_collocations([(r["text"], r["lang"]) for r in docs.collect()], 5, 150)
    assert {"en", "fr", "de"} <= {r[0] for r in got} and any(len(r[2].split(" ")) > 2 for r in got)
    assert collocations.mine(empty).collect() == []


def test_collocations_of_other_lengths(docs):
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    for longest, least in ((2, 20), (5, 8), (3, 300)):
        got = sorted(map(tuple, collocations.mine(docs, min_count=least, longest=longest).collect()))
        assert got == plain_collocations(rows, least, longest=longest)


def test_texts_are_read_as_often_whatever_the_candidates(spark, docs):
    rows = spark.sparkContext.accumulator(0)

    def reads(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    watched, read = docs.select("text", "lang").mapInArrow(reads, "text string, lang string"), []
    for options in ({}, {"automaton_limit": 200}, {"heavy_limit": 300}):
        before = rows.value
        found, words = collocations.counted(watched, min_count=5, **options)
        assert found.where("size > 1").count() > 600 and words.count() > 3
        read.append(rows.value - before)
    assert read[0] == read[1] == read[2] == 5 * docs.count()


def test_bits_find_all_their_cells_and_few_others():
    cells = np.unique(np.random.default_rng(5).integers(0, 1 << 34, 60_000, np.uint64))
    own, others, width = cells[::2], cells[1::2], 13
    words = np.zeros(1 << width, np.uint64)
    at, bits = collocations.Bits.of(own, width)
    np.bitwise_or.at(words, at, bits)
    table = collocations.Bits(width, words)
    assert table.has(own).all() and table.has(others).mean() < 0.03


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 9 * 10**15
    f = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(collocations, "counted", lambda docs, **_: (f, spark.createDataFrame([("en", 3 * big)], "lang string, n long")))
    (r,) = collocations.mine(None).collect()
    assert r["score"] == 2_000_000 * (big - 2) // (2 * big - 1)


def test_sketch_bounds_are_never_too_low():
    rng = random.Random(3)
    text = b"".join(rng.choice([b"A ", b"b\t ", "\u00e9\u00c9 ".encode(), b"x\x00 ", b". ", b";"]) for _ in range(3000))
    buffer = collocations.prepared([text, b"", b"a b"])
    tokens = buffer.tobytes().split(b" ")[1:-1]
    words = collocations.words_of(buffer)
    assert [buffer[s:e].tobytes() for s, e in zip(words.start, words.end)] == tokens
    for bits in (20, 40):
        for n, at, h in collocations.phrases(words, "en", 4):
            plain = Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1) if b"." not in tokens[i : i + n])
            own = collocations.cells_of(h, n, bits).tolist()
            cells = Counter(own)
            assert len(at) == sum(plain.values())
            for i, c in zip(at.tolist(), own):
                assert cells[c] >= plain[tuple(tokens[i : i + n])]


def test_parts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "PART", 20)
    text = b"one two three. four five; six seven eight nine ten eleven twelve, thirteen. x"
    buffer = collocations.prepared([text])
    found = Counter()
    for part in collocations.parts(buffer):
        assert part[0] == part[-1] == 32
        words = collocations.words_of(part)
        for n, _, h in collocations.phrases(words, "en", 3):
            found.update((n, c) for c in h.tolist())
    whole = Counter((n, c) for n, _, h in collocations.phrases(collocations.words_of(buffer), "en", 3) for c in h.tolist())
    assert found == whole


# -- 12 ----------------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_search(docs, items, k=10):
    terms = [(i, Counter(TERM.findall(ascii_lower(t or "")))) for i, t in docs]
    terms = [(i, c, c.total()) for i, c in terms if c]
    total, length = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in set(items):
        asked = set(TERM.findall(ascii_lower(text or ""))) & set(w)
        scores = []
        for i, c, n in terms:
            m = 10 + 90 * n * total // length
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block": 7, "shard": 16}, {"k": 3, "shard": 50}])
def test_lexical_search(spark, docs, empty, options):
    own = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own += [(500, None), (501, ""), (502, "the THE É of"), (503, "nowhere-to-be-found-zzz"), own[0], (own[1][0], "and another text of the same id"), (None, "der die das"), (504, "of the " * 9000)]
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in own], "item_id long, text string, rank int, query string")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], own, options.get("k", 10))
    found = lexical_search.search(docs, items, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert lexical_search.search(empty, items).collect() == [] and lexical_search.search(docs, items.limit(0)).collect() == []


def test_equal_documents_and_ties(spark):
    rows = [(i, "red green blue") for i in range(300, 0, -1)] + [(1000 + i, f"red w{i}") for i in range(40)] + [(0, "green"), (7, "blue blue blue")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(1, "red green"), (2, "w5 red"), (3, "blue")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert sorted(map(tuple, lexical_search.search(docs, items, shard=64).collect()), key=str) == plain_search(rows, asked)


def test_treaps_and_their_splits():
    rng = np.random.default_rng(5)
    for _ in range(40):
        docs, terms = int(rng.integers(1, 120)), int(rng.integers(1, 7))
        pairs = np.unique(rng.integers(0, [terms, docs], (int(rng.integers(1, 300)), 2)), axis=0)
        impact = rng.integers(1, 6, len(pairs)) if rng.random() < 0.5 else pairs[:, 1] + 1  # many ties, or a chain
        treaps = lexical_search.Treaps(pairs[:, 0], pairs[:, 1], impact, terms)
        for i in range(len(treaps.doc)):
            for child, less in ((treaps.left[i], True), (treaps.right[i], False)):
                assert child < 0 or (treaps.impact[child] <= treaps.impact[i] and (treaps.doc[child] < treaps.doc[i]) == less)
        queries = [np.unique(rng.integers(0, terms, 3)) for _ in range(9)]
        ids, best = np.sort(rng.permutation(1000)[:docs]), lexical_search.Best(9, 4)
        lexical_search.Search(None, 4).traverse(treaps, queries, ids, best)
        for q, own in enumerate(queries):
            score = np.bincount(pairs[:, 1], impact * np.isin(pairs[:, 0], own), docs).astype(int)
            want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s)[:4]
            assert [(-s, i) for s, i in zip(best.score[q].tolist(), best.id[q].tolist()) if s] == want


def test_ranges_that_cannot_enter_are_left_out(monkeypatch):
    """The traversal scores few of the documents that hold a term of the query."""
    rng = np.random.default_rng(9)
    docs = 8000
    pairs = np.unique(rng.integers(0, [5, docs], (15_000, 2)), axis=0)
    impact = (rng.pareto(1.0, len(pairs)) * 100).astype(np.int64) + 1
    treaps = lexical_search.Treaps(pairs[:, 0], pairs[:, 1], impact, 5)
    scored = []
    add = lexical_search.Best.add
    monkeypatch.setattr(lexical_search.Best, "add", lambda self, query, score, id_: (scored.append(len(query)), add(self, query, score, id_)))
    best = lexical_search.Best(1, 10)
    lexical_search.Search(None, 10).traverse(treaps, [np.arange(5)], np.arange(docs), best)
    score = np.bincount(pairs[:, 1], impact, docs).astype(np.int64)
    assert sorted(best.score[0].tolist(), reverse=True) == sorted(score.tolist(), reverse=True)[:10]
    assert sum(scored) < len(np.unique(pairs[:, 1])) / 10


# -- 13 ----------------------------------------------------------------------------------------------------------------


def plain_nearest(rows, every, k):
    """{query row number: [(distance, id)]}, of rows (id, vector or None)."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            near = [(math.dist(v, w), j is None, j or 0) for b, (j, w) in enumerate(good) if b != at and len(w) == len(v)]
            out += [(i, r + 1, None if none else j, d) for r, (d, none, j) in enumerate(sorted(near)[:k])]
    return out


def recall(found, want):
    """The share of a query's nearest, or others as near, that are found; scores of found ones are right."""
    worst = {}
    for q, r, _, d in want:
        worst[q] = max(worst.get(q, 0), d)
    hits = sum(d <= worst[q] + 1e-12 for q, _, _, d in found)
    return hits / len(want)


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_recall_of_adaptive_search(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 48))
    if kind == "clusters":
        x = rng.standard_normal((30, 48))[rng.integers(0, 30, 3000)] * 4 + x * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = [tuple(r) for r in adaptive_search.search(table, every=30).collect()]
    want = plain_nearest(rows, 30, 10)
    assert recall(found, want) >= 0.9 and len(found) == len(want)
    for q, _, v, d in found:
        assert d == pytest.approx(math.dist(rows[q][1], rows[v][1]), abs=1e-12)


def test_adaptive_search_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(20).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(200, rows[0][1]), (200, rows[0][1]), (None, rows[0][1]), (None, rows[3][1])]  # a hot vector
    rows += [(300, None), (301, [0.0] * 20), (302, [float("nan")] * 20), (303, [float("inf")] + [1.0] * 19), (304, [None] + [1.0] * 19), (305, [])]
    rows += [(400, [1.0, 2.0, 3.0]), (401, [1.0, 2.0, 4.0]), (500, [5.0]), (600, [1e200] * 4), (601, [1e-200] * 4)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    found = sorted((tuple(r) for r in adaptive_search.search(table, every=100, target=1.0, tolerance=8.0).collect()), key=key)
    want = sorted(plain_nearest(rows, 100, 10), key=key)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want])
    assert adaptive_search.search(table.limit(0)).collect() == []
    assert adaptive_search.search(table.where("vec_id = 500"), every=100).collect() == []


def test_queries_of_thin_lists_get_all_lists(spark):
    """Vectors far apart: the lists that a query probes hold fewer than it asks for."""
    rows = [(i, [float(10**9 if j == i else 0) for j in range(70)]) for i in range(70)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = adaptive_search.search(table, every=10, target=0.01, tolerance=8.0).collect()
    assert len(found) == 7 * 10 and {r["score"] for r in found} == {math.sqrt(2) * 1e9}


def test_large_lists_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(adaptive_search, "BLOCK", 50)
    monkeypatch.setattr(adaptive_search, "QUERIES", 8)
    rng = np.random.default_rng(2)
    rows = [(i, (5 + 0.1 * rng.standard_normal(24)).tolist()) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in adaptive_search.search(table, every=20, target=1.0, tolerance=8.0).collect()]
    assert recall(found, plain_nearest(rows, 20, 10)) == 1.0 and len(found) == 45 * 10


def test_few_candidates_are_measured():
    """Tests abandon most candidates before the last column."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 64)) * 2
    x = np.vstack([c + 0.4 * rng.standard_normal((100, 64)) for c in centres])
    scan = adaptive_search.Scan(10, 2.5)
    d = np.sqrt(adaptive_search.squared(x[:5], x).clip(0))
    bound = np.sort(d, 1)[:, 10]
    i, j = scan.passing(scan.blocks(x[:5]), scan.blocks(x), bound, 64)
    near = np.argwhere(d <= bound[:, None])
    found = set(zip(i.tolist(), j.tolist()))
    assert len(found) < 0.03 * 5 * len(x)
    assert np.mean([tuple(p) in found for p in near.tolist()]) > 0.97


