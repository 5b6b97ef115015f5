"""Candidate sets of few long texts, compared in blocks of which some are empty."""

from __future__ import annotations

from lexora.llm import lsh_forest
from tests.llm.conftest import prose
from tests.llm.test_groups import linked


def test_blocks_without_texts(spark, monkeypatch):
    docs = []
    for i in range(12):
        words = prose(900 + i, 400).split()
        docs += [(10 * i + k, " ".join([*words[:200], f"changed{k}", *words[201:]])) for k in range(2 + i % 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = linked(docs)[0]
    assert {r[3] for r in want} == {1, 2}
    for words in (500, 150):  # 2 and 6 blocks for a pair, 3 and 8 for three texts
        monkeypatch.setattr(lsh_forest, "BLOCK_WORDS", words)
        assert sorted((tuple(r) for r in lsh_forest.join(df).collect()), key=str) == want
