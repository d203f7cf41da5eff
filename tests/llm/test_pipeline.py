"""The pipeline against plain versions of its stages."""

import collections
import re

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from motifloom.llm import pii, quality
from tests.llm.test_operators import VOCABULARY, plain_classes, plain_targets

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, judge = docs.columns, quality.Judge(quality.Rules())
    data = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "encoding"]
    after = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert name == "encoding" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after[name] = [r.asDict() for r in docs.collect()]
        if name == "near-duplicates":
            replaced = {r["doc_id"]: r["text"] for r in pii.replace(docs, corpus_pipeline.KEY).collect()}
    judged = {i: judge.document(r["text"]) for i, r in data.items()}
    assert {r["doc_id"]: r["text"] for r in after["quality rules"]} == {i: j["clean_text"] for i, j in judged.items() if j["kept"]}
    assert all(r["n_chars"] == len(r["text"]) for r in after["quality rules"])
    labels = plain_classes([r["text"] for r in after["quality rules"]])
    least = {}
    for r in after["quality rules"]:
        least[labels[r["text"]]] = min(r["doc_id"], least.get(labels[r["text"]], 10**9))
    assert sorted(r["doc_id"] for r in after["near-duplicates"]) == sorted(least.values())
    assert {r["doc_id"]: r["text"] for r in after["personal data"]} == replaced
    sizes, words = collections.Counter(), {}
    for r in after["personal data"]:
        words[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        sizes[r["source"]] += words[r["doc_id"]]
    names = sorted(sizes)
    taken = collections.Counter()
    for r in after["mixing"]:
        taken[r["source"]] += words[r["doc_id"]]
    for s, target in zip(names, plain_targets([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))])):
        assert abs(taken[s] - target) <= max(words.values())
    reference = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter((r["doc_id"], len(reference.encode(r["text"], add_special_tokens=False).ids)) for r in after["mixing"])
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in after["encoding"]) == want


def test_ties_repeated_rows_and_clashing_names(spark):
    """Rows of one text or id, rows that repeat whole, and columns named like those the operators make."""
    text = " ".join(f"word{i} is here." for i in range(60))
    other = " ".join(f"thing{i} was there." for i in range(60))
    rows = [(1, text, "en", "s", 3, True, "r"), (1, text, "en", "s", 3, True, "r"), (2, text, "de", "t", 3, False, "q"), (3, other, "en", "s", 3, True, "r"), (3, other + " Mrs Anna Smith met Smith.", "en", "s", 3, True, "r"), (None, other, "en", None, 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        kept = [r.asDict() for r in docs.collect()]
        sizes.append(len(kept))
        assert all(r["kept"] is not False for r in kept) or name == "quality rules"
    assert sizes[:3] == [6, 2, 2]  # one of each of the two classes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("n_tokens > 0").count() == sizes[3]


@pytest.mark.parametrize("rows", [[], [(1, None, "en", None, 3), (1, None, "en", None, 3), (2, "", "en", "s", 0)]])
def test_nulls_and_empty_tables_pass_through(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
