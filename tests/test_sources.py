"""Readers and writers, as round trips over small files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.sources import readers, writers


def test_narrow_peak(spark, tmp_path):
    lines = ["track type=narrowPeak", "chr1 10 30 p 5 . 1.5 2 3 7", "chr1\t40\t61", "chrM 1 9 q 2 + 1 1 1 3"]
    with gzip.open(tmp_path / "a.narrowPeak.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = readers.narrow_peak(spark, str(tmp_path / "a.narrowPeak.gz")).orderBy("contig", "start").collect()
    assert [(r["contig"], r["start"], r["stop"], r["summit"], r["score"], r["signal_value"]) for r in got] == [("chr1", 10, 30, 7, 5.0, 1.5), ("chr1", 40, 61, 10, -1.0, -1.0), ("chrM", 1, 9, 3, 2.0, 1.0)]
    assert readers.narrow_peak(spark, str(tmp_path / "a.narrowPeak.gz"), 2).count() == 2


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\nGG\n")
    got = {r["contig"]: (r["seq"], r["stop"], r["summit"]) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {">one x": ("ACGTAC", 6, 3), ">two": ("GG", 2, 1)}
    writers.fasta(readers.fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert readers.fasta(spark, str(tmp_path / "out")).count() == 2


def test_fastq(spark, tmp_path):
    df = spark.createDataFrame([(i, "ACGTN"[: 3 + i % 3]) for i in range(20)], "seq_id long, seq string").coalesce(1)
    writers.fastq(df, str(tmp_path / "exp_3"))
    got = readers.fastq(spark, str(tmp_path / "exp_3"))
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in df.collect())
    assert spark.range(1).select(readers.fastq_round(F.lit("/x/TF_4.fastq.gz"))).first()[0] == 4


def test_record_marks_within_records(spark, tmp_path):
    """A quality line may begin with @, also the first of a file, and a header may hold >."""
    (tmp_path / "r_1.fastq").write_text("@a\nACGT\n+\n@III\n@b x@y\nNNA\n+b\n@@@\n@c\nGG\n+\n+@\n@d\nTTTT\n+\nIII@\n")
    assert sorted(r["seq"] for r in readers.fastq(spark, str(tmp_path / "r_1.fastq")).collect()) == ["ACGT", "GG", "NNA", "TTTT"]
    (tmp_path / "a.fa").write_text("\n>a>b c>d\nACGT\r\nAC\r\n>two\nGG")
    assert sorted((r["contig"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()) == [(">a>b c>d", "ACGTAC"), (">two", "GG")]


def test_motifs_and_models(spark, tmp_path):
    pwm = np.array([[0.7, 0.1, 0.1, 0.1], [0.25, 0.25, 0.25, 0.25]])
    (tmp_path / "m.txt").write_text(writers.motif_text("abc_x1_selex", pwm) + writers.motif_text("def_y", pwm))
    got = readers.motifs(spark, str(tmp_path / "m.txt"), ["ABC"]).collect()
    assert len(got) == 1 and got[0]["factor"] == "abc" and np.allclose(got[0]["matrix"], pwm)
    text = ">x.ENERGY\t-1.5\n1 0 1 2 3\n>x.PWM\n1 .1 .2 .3 .4\n"
    name, energy, e, p = readers.energy_file(text)
    assert (name, energy, e.tolist(), p.tolist()) == ("x", -1.5, [[0, 1, 2, 3]], [[0.1, 0.2, 0.3, 0.4]])
    with pytest.raises(ValueError):
        readers.energy_file(text.split(">x.PWM")[0])
    (tmp_path / "b.json").write_text(json.dumps({"id": "1", "name": "n", "pwm": [[0.1, 0.2, 0.3, 0.4]]}))
    assert readers.binding_models(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"id": "1", "name": "n", "pwm": [[2, 0, 0, 0]]}))
    with pytest.raises(Exception, match="malformed"):
        readers.binding_models(spark, str(tmp_path / "c.json")).collect()


def test_tables_and_lists(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("File accession\tn (new)\nA\t1\n")
    assert readers.table(spark, str(tmp_path / "t.tsv")).columns == ["File_accession", "n_new"]
    (tmp_path / "p.csv").write_text('"","chr","start","strand","x","score"\n"1","chr1",5,"+",0,0.5\n')
    assert [tuple(r) for r in readers.sites_from_csv(spark, str(tmp_path / "p.csv")).collect()] == [("chr1", 5, 6, 0.5)]
    (tmp_path / "d").mkdir()
    for n in ("E1.TF1.bed", "E2.TF2.bed", "readme"):
        (tmp_path / "d" / n).write_text("chr1\t1\t2\n")
    got = readers.listing(spark, str(tmp_path / "d"), r"^(\w+)\.(\w+)\.bed$", ["sample", "tf"])
    assert sorted((r["sample"], r["tf"]) for r in got.collect()) == [("E1", "TF1"), ("E2", "TF2")]
    wide = spark.createDataFrame([(1.0, 2.0, 3.0)], ["K562|X|a", "K562|CTCF|b", "K562|CTCF|c"])
    assert readers.wide_scores(wide, "K562", "CTCF").first()[0] == 2.0
    (tmp_path / "e.json").write_text(json.dumps({"accession": "E", "assay": "x", "target": "t", "files": [{"accession": "F1"}, {"accession": "F2"}]}))
    assert readers.experiments(spark, str(tmp_path / "e.json")).count() == 2


def test_written_tracks_and_intervals(spark, tmp_path):
    df = spark.createDataFrame([(c, p, p / 2) for c in ("a", "b") for p in range(10)], "contig string, pos long, score double")
    writers.scores(df, str(tmp_path / "s"))
    assert readers.tracks(spark, str(tmp_path / "s"), "b", 3, 6).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        writers.scores(df, str(tmp_path / "s"))
    writers.bed_graph(df, str(tmp_path / "g"))
    assert readers.bed(spark, str(tmp_path / "g")).count() == 20
    peaks = df.select("contig", F.col("pos").alias("start"), (F.col("pos") + 5).alias("stop"))
    writers.sorted_intervals(peaks, str(tmp_path / "i"))
    assert readers.bed(spark, str(tmp_path / "i")).count() == 20
    writers.features(peaks, str(tmp_path / "f"))
    assert readers.table(spark, str(tmp_path / "f")).count() == 20
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert readers.cached(spark, str(tmp_path), "a/b c", make).count() == 20
    assert calls == [1]


def test_label_matrix_has_its_names_beside_it(spark, tmp_path):
    df = spark.createDataFrame([(1, "B", 1), (1, "A", 0), (2, "B", -1)], "row_id long, tf_id string, label int")
    writers.matrix(df, str(tmp_path / "m"), "row_id", "tf_id", "label", ["B", "A"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m.tfnames")).collect()] == ["A", "B"]
    assert spark.read.parquet(str(tmp_path / "m")).columns == ["row_id", "B", "A"]
