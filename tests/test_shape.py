"""Shape features and energies from differences against plain versions."""

import itertools

import numpy as np
import pytest

from motifloom.functions import physics
from motifloom.operators import shape

RNG = np.random.default_rng(6)
WORDS = ["".join(w) for w in itertools.product("ACGT", repeat=5)]
VALUES = {w: RNG.normal(size=2) for w in WORDS if w != "AAAAA"}
DIFFERENCES, WEIGHTS = RNG.normal(size=(3, 4)), RNG.normal(size=(2, 4))


def other(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def features(seq):
    return [VALUES.get(seq[i - 2 : i + 3], np.zeros(2)) if 2 <= i < len(seq) - 2 else np.zeros(2) for i in range(len(seq))]


def plain_energy(seq, with_shape):
    """The lowest energy: each strand is read from its own beginning."""
    found = []
    for s in (seq.upper(), other(seq.upper())):
        own = features(s)
        for i in range(len(s) - 3):
            if set(s[i : i + 4]) <= set("ACGT"):
                e = sum(0 if b == "A" else DIFFERENCES["CGT".index(b), k] for k, b in enumerate(s[i : i + 4]))
                found.append(e + (sum(own[i + k] @ WEIGHTS[:, k] for k in range(4)) if with_shape else 0))
    return min(found) if found else None


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(w, float(a), float(b)) for w, (a, b) in VALUES.items()], "word string, a double, b double")


SEQS = ["ACGTTGCAAC", "acgttgcaac", "AAAAAAAAAA", "ACGNTTGACCANG", "ACG", "", None, "".join(RNG.choice(list("ACGT"), 3000)), "NNNNNNNN", "ACGT"]


@pytest.mark.parametrize("part", [7, 1 << 20])
@pytest.mark.parametrize("with_shape", [False, True])
def test_energies(spark, table, monkeypatch, with_shape, part):
    monkeypatch.setattr(shape, "PART", part)
    df = spark.createDataFrame(list(enumerate(SEQS)), "seq_id long, seq string")
    extra = {"shape": WEIGHTS, "table": table, "features": ["a", "b"]} if with_shape else {}
    got = {r["seq_id"]: r["energy"] for r in shape.affinities(df, DIFFERENCES, **extra).collect()}
    assert got == {i: pytest.approx(e) if s and (e := plain_energy(s, with_shape)) is not None else None for i, s in enumerate(SEQS)}


def test_sums(spark, table):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(SEQS)], "seq_id long, seq string, own string")
    for r in shape.shape_sums(df, table, ["a", "b"]).collect():
        s = SEQS[r["seq_id"]]
        if not s:
            assert r["a_fwd"] is None
            continue
        for strand, seq in (("fwd", s.upper()), ("rc", other(s.upper()))):
            assert [r[f"a_{strand}"], r[f"b_{strand}"]] == pytest.approx(np.sum(features(seq), 0).tolist())


def test_differences_are_those_of_a_matrix():
    ddg = np.abs(RNG.normal(size=(6, 4)))
    reference, diff = physics.differences(physics.EnergyModel(ddg))
    codes = RNG.integers(0, 4, 200)
    fwd, rc = shape.site_energies(codes, diff)
    want = [sum(ddg[k, c] for k, c in enumerate(codes[i : i + 6])) for i in range(195)]
    back = [sum(ddg[k, 3 - c] for k, c in enumerate(codes[i : i + 6][::-1])) for i in range(195)]
    assert fwd + reference == pytest.approx(want) and rc + reference == pytest.approx(back)


def test_tables_are_checked(spark):
    for rows in ([("ACG", 1.0)], [("ACGTN", 1.0)], [("ACGTA", 1.0)] * 1025):
        with pytest.raises(ValueError):
            shape.lookup(spark.createDataFrame(rows, "word string, a double"), ["a"])
