"""The rankers of blocking pairs must not pass for retrieval over all targets."""

import os
import re

from conftest import ROOT
from matchbook.plans.catalog import ORACLE, QUERIES


def test_rerankers_are_named_as_such():
    assert {"bm25_rerank", "tfidf_rerank"} <= set(QUERIES) & set(ORACLE)
    assert not {"bm25_topk", "tfidf_topk"} & set(QUERIES)
    with open(os.path.join(ROOT, "README.md"), encoding="utf-8") as f:
        areas = [line.split("|")[1] for line in f if line.startswith("| Retrieval")]
    assert areas and not any(re.search("M0[45]", a) for a in areas)
