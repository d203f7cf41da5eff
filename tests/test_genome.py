"""Numbered lines and genomes of chunks, for one split and many, plain and compressed."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from motifloom.operators import intervals
from motifloom.sources import genome, readers


@pytest.fixture(params=[1 << 30, 1000, 64])
def split(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(path, text):
    with gzip.open(path, "wt", newline="") if str(path).endswith("gz") else open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("suffix", ["txt", "txt.gz"])
def test_lines_are_numbered(spark, split, tmp_path, suffix):
    rng = random.Random(1)
    texts = [["x" * rng.randint(0, 30) + str(i) if i % 5 else "" for i in range(400)] for _ in range(2)]
    for i, t in enumerate(texts):
        put(tmp_path / f"{i}.{suffix}", "\n".join(t) + "\n")
    found = genome.numbered_lines(spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        own = sorted((r["line"], r["value"]) for r in found if r["file"].endswith(f"{i}.{suffix}"))
        assert own == list(enumerate(t))
    if split == 64 and suffix == "txt":
        assert genome.lines(spark, str(tmp_path)).select("block").distinct().count() > 20


def test_first_peaks_and_zipped_files(spark, split, tmp_path):
    peaks = put(tmp_path / "p.narrowPeak", "track name=x\n\n" + "".join(f"chr{i % 3}\t{i * 10}\t{i * 10 + 5}\tn\t{i}\n" for i in range(300)))
    got = readers.narrow_peak(spark, peaks, limit=37).collect()
    assert sorted(r["start"] for r in got) == [i * 10 for i in range(37)]
    assert readers.narrow_peak(spark, peaks).count() == readers.narrow_peak(spark, peaks, limit=1000).count() == 300
    left, right = put(tmp_path / "l.txt", "".join(f"p{i}\n" for i in range(200))), put(tmp_path / "r.txt", "".join(f"label {i}\n" for i in range(170)))
    assert sorted(map(tuple, genome.zipped_lines(spark, left, right).collect())) == [(i, f"p{i}", f"label {i}") for i in range(170)]


@pytest.mark.parametrize("suffix", ["fa", "fa.gz"])
def test_genome_of_many_lines(spark, split, tmp_path, suffix):
    rng = random.Random(2)
    contigs = {f"chr{i}": "".join(rng.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((5000, 0, 1, 64, 63, 1234))}
    text = ["stray bases before any header\n"]
    for name, seq in contigs.items():
        text.append(f">{name} a description\r\n" if name == "chr3" else f">{name}\n")
        at = 0
        while at < len(seq):
            n = rng.choice([1, 7, 60, 60, 200])
            text.append(seq[at : at + n] + rng.choice(["\n", "\n", "\n\n", " \n"]))
            at += n
    put(tmp_path / f"a.{suffix}", "".join(text))
    put(tmp_path / f"b.{suffix}", ">other\nACGT\nAC\n")
    contigs["other"] = "ACGTAC"
    rows = genome.genome(spark, str(tmp_path), chunk=64).collect()
    assert max(len(r["seq"]) for r in rows) == 64 and len(rows) == len({(r["contig"], r["chunk"]) for r in rows})
    for name, seq in contigs.items():
        own = sorted((r["chunk"], r["seq"]) for r in rows if r["contig"] == name)
        assert own == [(i, seq[i * 64 : i * 64 + 64]) for i in range(-(-len(seq) // 64))]


def test_fetch_from_a_large_contig(spark, tmp_path):
    """A contig of two million bases, in splits: no value is longer than a chunk, and windows are Python's slices."""
    rng = random.Random(3)
    seq = "".join(rng.choices("ACGT", k=2_000_000))
    path = put(tmp_path / "g.fa", ">chr1\n" + "\n".join(seq[i : i + 61] for i in range(0, len(seq), 61)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300_000)
    try:
        table = genome.genome(spark, path, chunk=4096).cache()
        assert table.agg(F.max(F.length("seq")), F.count("*"), F.sum(F.length("seq"))).first() == (4096, -(-2_000_000 // 4096), 2_000_000)
        spots = [(i, "chr1", s, s + n) for i, (s, n) in enumerate((rng.randrange(1_999_000), rng.choice([1, 50, 900, 9000])) for _ in range(80))]
        regions = spark.createDataFrame(spots, "row_id long, contig string, start long, stop long")
        assert {r["row_id"]: r["seq"] for r in intervals.fetch(table, regions, chunk=4096).collect()} == {i: seq[s:e] for i, _, s, e in spots}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert genome.genome(spark, put(tmp_path / "empty.fa", "")).count() == 0
