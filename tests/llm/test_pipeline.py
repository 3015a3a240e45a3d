"""Every stage of the pipeline against what its predecessor kept."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from conftest import SF0001
from matchbook.llm import decontaminate
from matchbook.llm.common import table, written
from matchbook.llm.tokens import default_tokenizer


def test_stages(spark):
    from test_operators import _classes
    from tokenizers import Tokenizer

    docs = table(spark, SF0001, "documents")
    columns, out = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF0001), name)
        out.append(docs.collect())
        if name != "token_output":
            assert docs.columns == columns
    first, known, unique, clean, mixed, shards = out
    assert {r.doc_id for r in known} >= {r.doc_id for r in first if r.text and any(map(str.isalpha, r.text))}
    classes = _classes({r.doc_id: r.text for r in known})
    assert sorted(r.doc_id for r in unique) == sorted(set(classes.values()))
    index = decontaminate.WindowIndex([(r.item_id, r.text.encode()) for r in table(spark, SF0001, "benchmark").collect()], 10)
    hit = {r.doc_id for r in unique if decontaminate._scan_texts(index, [(r.text or "").encode()])[0][1]}
    assert hit and sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in unique if r.doc_id not in hit)
    assert set(mixed) <= set(clean)
    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in mixed}
    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in mixed)
    at = 0
    for r in sorted(shards, key=lambda r: r.start):
        own = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
