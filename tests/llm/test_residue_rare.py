"""Residue that is rarer than the sample of documents."""

import pytest

from loam.llm.residue import SAMPLE_PASSAGES, Residue, _kept, fit, passages, residue_documents, verdict
from tests.llm.test_llm import NOTES, RESIDUE


@pytest.mark.parametrize("sample_docs", [40, 200])
def test_rare_residue_outside_the_sample_is_found(spark, sample_docs):
    notes = [NOTES[i % 4] % (i % 9) for i in range(12_000)]
    bad = [t % i for i in range(1, 4) for t in RESIDUE]
    # a sample of all documents would hold none or few of the twelve
    docs = spark.createDataFrame(list(enumerate(notes + bad)), "doc_id long, text string").repartition(4)
    assert len(fit(docs, sample_docs).weights) > 0
    assert {r["doc_id"] for r in residue_documents(docs, sample_docs).collect()} == set(range(12_000, 12_012))


def test_trusted_passages_decide_whatever_was_learned():
    for text in RESIDUE:
        assert verdict(Residue({}, -4.0), "# Ann Lee\n" + text % 7) > 2
    assert verdict(Residue({}, -4.0), NOTES[2] % 7) < 2


def test_a_share_of_a_huge_corpus_does_not_round_to_nothing(spark):
    docs = spark.createDataFrame([(i, (NOTES[i % 4] if i % 3 else RESIDUE[i % 4]) % (i % 9)) for i in range(300)], "doc_id long, text string")
    # as if these were some of 10^11 documents: no other document is within the share, trusted ones still teach
    model = fit(docs, 8_000, total=10**11)
    assert len(model.weights) > 0 and model.bias > -1e6
    assert fit(docs.limit(0)).bias == -1e9


def test_long_slots_and_long_records():
    model = Residue({}, -4.0)
    assert verdict(model, "{{" + "please fill in the name of the person in charge " * 4 + "}}") > 2
    notes = " ".join(NOTES[i % 4] % i for i in range(400))
    assert verdict(model, notes) < 2 and verdict(model, notes + "\n" + RESIDUE[0] % 3) > 2
    kept = _kept(passages(notes + "\n" + RESIDUE[0] % 3))
    assert len(kept) == SAMPLE_PASSAGES and any(x["s"] for x in kept)
