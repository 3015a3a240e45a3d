"""Strings of added tokens in texts, against the library as it comes."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from matchbook.llm import tokens

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b, c.", "two<|endoftext|><|endoftext|>\nlines  here",
         "no <|endoftext |> <|ENDOFTEXT|> here", "plain text.", ""]


def test_added_tokens_in_texts(spark):
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.tokenize_documents(docs).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = [*tok.encode(text, add_special_tokens=False).ids, tokens.END_ID]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tok.encode(TEXTS[0], add_special_tokens=False).ids == [64, 50256, 65]


def test_pieces_against_the_library(monkeypatch):
    """Marks, other white space, line ends and a dictionary that is often full."""
    monkeypatch.setattr(tokens, "CACHED_PIECES", 40)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abXé .,\n'1-\t\r\x0b　東!?s\x85\x1c", k=rng.randint(0, 60))) for _ in range(400)]
    texts += [sep.join("".join(rng.choices("abé'sT0.,-!東", k=rng.randint(1, 6))) for _ in range(20))
              for sep in " \n" for _ in range(200)]
    texts += [*TEXTS, "a <|endoftext|>\nb", " ", "\n", "a\n", "\na", "a\n\nb"]
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    for i in range(0, len(texts), 50):
        for text, ids in zip(texts[i:i + 50], encoder.encode(texts[i:i + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_each_new_piece_is_encoded_once(monkeypatch):
    """Pieces are learnt as they are looked up; the dictionary's older half is asked for single pieces, never walked."""
    class Older(dict):
        def __iter__(self):
            raise AssertionError("all known pieces are read")
        keys = items = __iter__

    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    texts = ["some words, once more.", "more words\nünd 1-2 some words."]
    before = encoder.encode(texts)
    monkeypatch.setattr(tokens, "CACHED_PIECES", 2)
    encoder.first.make_room()
    encoder.later.make_room()
    for half in (encoder.first, encoder.later):
        half.older = Older(half.older)
        monkeypatch.setattr(half, "_ids", None)  # nothing is encoded again
    monkeypatch.setattr(tokens, "CACHED_PIECES", 10**6)
    assert encoder.encode(texts) == before
