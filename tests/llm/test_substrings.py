"""Planted passages against windows of words, cut without the operator's code."""

import random

import pytest

from matchbook.llm import substrings


def _cases(kind, seed):
    rng = random.Random(seed)
    if kind == "han":
        def words(n): return [chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n)]
        glue = "".join
    else:
        def words(n): return ["".join(rng.choices("abcdefghijklmnoprstuvé", k=rng.randint(2, 8))) for _ in range(n)]
        glue = " ".join
    passage = words(51)
    if kind == "marks":
        passage = [w + rng.choices(["", ",", ".", "?"], [16, 1, 2, 1])[0] for w in passage]
    return passage, [glue([*words(rng.randint(3, 40)), *passage, *words(rng.randint(3, 40))]) for _ in range(2)]


def _windows(text, kind, size=51):
    words = list(text) if kind == "han" else text.split()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


@pytest.mark.parametrize("kind", ["bare", "marks", "han"])
def test_planted_passages_of_51_words(spark, kind):
    cases = [_cases(kind, seed) for seed in range(300)]
    rows = [(2 * i + k, text) for i, (_, texts) in enumerate(cases) for k, text in enumerate(texts)]
    got = {r.doc_id: r.text for r in substrings.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(_windows(a, kind) & _windows(b, kind) for _, (a, b) in cases)
    assert [i for i, (_, (a, _)) in enumerate(cases) if got[2 * i] != a] == []
    missed = [i for i, (p, _) in enumerate(cases) if tuple(p) in _windows(got[2 * i + 1], kind)]
    assert missed == []


@pytest.mark.parametrize("text", ["", " ", "a", "…", "one, two " * 30, "word " * 100, "東京、大阪。" * 9, "a　b\xa0c " * 20, "\n.\n x"])
def test_pieces_make_up_the_text(text):
    pieces = substrings.sentences(text)
    assert "".join(pieces) == text and all(pieces)
    assert all(len(substrings._words(p)) <= substrings.RUN for p in pieces)


def test_chunks_of_texts_agree_with_single_texts():
    rng = random.Random(7)
    texts = ["", "a", "x\0y. " * 30, "。” a " * 30, "\ud800 b " * 30, "東京、大阪。" * 9]
    texts += ["".join(rng.choices("abé .,\n!?。東”\"'(-\t\x85　", k=rng.randint(0, 400))) for _ in range(200)]
    texts += [" ".join(_cases(kind, 1)[1]) for kind in ("bare", "marks", "han")]
    cut = substrings.Cut(texts)
    found = {}
    for text, first, end, *hashes in zip(*(x.tolist() for x in cut.spans())):
        found.setdefault(text, []).append((first, end, tuple(hashes)))
    hash_of = {}
    for i, text in enumerate(texts):
        pieces = substrings.sentences(text)
        at = cut.pieces(i).tolist()
        assert [text[a:b] for a, b in zip(at, at[1:])] == pieces
        wanted = substrings.spans(pieces)
        assert [(a, b) for a, b, _ in wanted] == [(a, b) for a, b, _ in found.get(i, [])]
        for (_, _, words), (_, _, both) in zip(wanted, found.get(i, [])):
            assert hash_of.setdefault(words, both) == both
    assert len(set(hash_of.values())) == len(hash_of) > 100
