"""The operators against DuckDB, brute force, exact round trips and held-out labels."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF0001
from harness import compare
from matchbook.llm import chat, decontaminate, langid, mixing, neardup, quality, substrings, tokens, urlfilter, wrappers
from matchbook.llm.common import table
from matchbook.llm.queries import ORACLE, QUERIES
from matchbook.llm.wavelet import WaveletMatrix

SF001 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck0001, name):
    problems, n = compare(QUERIES[name](spark, SF0001), duck0001, ORACLE[name])
    assert not problems and n


# -- near duplicates ----------------------------------------------------------------

def _classes(texts: dict[int, str | None]) -> dict[int, int]:
    bags = {}
    for i, t in texts.items():
        w = decontaminate.words_of((t or "").encode())
        size = min(5, len(w))
        bags[i] = Counter(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if size else None
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in texts if bags[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            la, lb = bags[a].total(), bags[b].total()
            if 5 * min(la, lb) < 4 * max(la, lb):
                continue
            common = (bags[a] & bags[b]).total()
            if 5 * common >= 4 * (la + lb - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_brute_force(spark):
    docs = table(spark, SF0001, "documents").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == _classes({r.doc_id: r.text for r in docs.collect()})


def test_near_duplicates_in_large_mixed_buckets(spark, monkeypatch):
    """Chains of edits and half-shared texts, with groups so small that buckets are split several times."""
    monkeypatch.setattr(neardup, "GROUP", 3)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 120, i % 8):
            words[k] = f"x{rng.integers(0, 10**6)}"
        texts[i] = " ".join(words)
    texts |= {100 + i: texts[0] for i in range(5)} | {200: None, 201: "", 202: "?!"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == _classes(texts)
    kept = [r.doc_id for r in neardup.keep_representatives(docs).collect()]
    assert sorted(kept) == sorted(set(_classes(texts).values()))


def test_near_duplicates_that_only_prefixes_tell(spark, monkeypatch):
    """All texts fall into one bucket whose smallest text is like none of them; a passage fills most of each."""
    monkeypatch.setattr(neardup, "band_keys", lambda sig, *_: np.zeros((len(sig), neardup.BANDS), np.int64))
    rng = np.random.default_rng(8)
    shared = [f"p{x}" for x in range(70)]
    texts = {0: "a text of its own that nothing else is similar to"}
    for i in range(1, 40):
        texts[i] = " ".join(shared + [f"u{i}x{k}" for k in range(30)])
        if i % 3 == 0:
            words = texts[i].split()
            words[int(rng.integers(75, 95))] = "other"
            texts[100 + i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == _classes(texts)
    assert got[103] == 3 and got[1] == 1


def test_buckets_of_the_same_texts_count_once(spark):
    rows = [(k, i, 9) for k, ids in ((1, (1, 2, 3)), (2, (1, 2, 3)), (3, (1, 2)), (4, (2, 3)), (5, (7,)), (6, (3, 2))) for i in ids]
    left = neardup._unlike(spark.createDataFrame(rows, "key long, id long, size long")).collect()
    assert sorted((r.key, r.id) for r in left) == [(1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (4, 2), (4, 3)]


def test_near_duplicates_shuffle_no_text_again(spark, monkeypatch):
    """However long the list of wanted texts, a join with the texts shuffles the list alone."""
    plans, real = [], neardup._texts_of

    def texts_of(*args):
        found = real(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(neardup, "_texts_of", texts_of)
    before, words = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i // 2}"])) for i in range(8)], "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert {r.class_id for r in neardup.near_duplicates(docs).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and all(p.count("Exchange") == 1 for p in plans)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("matchbook_texts")]


def test_prefixes_of_similar_multisets_meet():
    rng = np.random.default_rng(2)
    frequency = rng.integers(0, 50, neardup.SLOTS)
    met = 0
    for _ in range(300):
        keys = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        counts = rng.integers(1, 5, len(keys))
        other = np.maximum(1, counts + rng.integers(-1, 2, len(keys)) * (rng.random(len(keys)) < 0.5))
        if 5 * np.minimum(counts, other).sum() >= 4 * np.maximum(counts, other).sum():
            met += 1
            assert len(np.intersect1d(neardup.prefix(keys, counts, frequency), neardup.prefix(keys, other, frequency)))
    assert met > 50


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = (keys, rng.integers(1, 9, 60)), (keys, rng.integers(1, 9, 60))
    sig = neardup.signatures([a, b], m=4096)
    true = np.minimum(a[1], b[1]).sum() / np.maximum(a[1], b[1]).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


# -- token shards -------------------------------------------------------------------

def test_token_shards_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    tok.encode_special_tokens = True
    docs = table(spark, SF0001, "documents")
    got = {r.doc_id: r for r in tokens.tokenize_documents(docs).collect()}
    start = 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 511, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint32)
    w = WaveletMatrix.build(ids)
    w = WaveletMatrix.from_parts(w.parts())
    assert (w.ids() == ids).all()
    if n:
        at = np.arange(0, n, 7)
        assert (w.access(at) == ids[at]).all()
        for t in (int(ids[0]), 299, 10_000):
            assert (w.occurrences(t) == np.flatnonzero(ids == t)).all()
            assert w.count(t, n // 3, n) == (ids[n // 3:] == t).sum()


# -- language, spans, html ------------------------------------------------------------

def test_language_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF001).collect()}
    true = {r.doc_id: r.lang for r in table(spark, SF001, "documents").collect()}
    own = [i for i, r in rows.items() if r.held_out and true[i] is not None and r.lang_pred != "und"]
    assert len(rows) == len(true) and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert np.mean([rows[i].lang_pred == true[i] for i in own]) > 0.95


def test_sentence_spans_brute_force(spark):
    docs = table(spark, SF0001, "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    places = defaultdict(list)
    for i in sorted(texts):
        for first, _, words in substrings.spans(substrings.sentences(texts[i] or "")):
            places[words].append((i, first))
    later = defaultdict(list)
    for found in places.values():
        for i, first in sorted(found)[1:]:
            later[i].append(first)
    got = {r.doc_id: r.text for r in substrings.dedup_spans(docs).collect()}
    assert later
    for i, t in texts.items():
        assert got[i] == (None if t is None else substrings.remove_places(t, later[i])[0])


def test_wrappers_find_the_article(spark):
    page = ("<html><head><title>T{0}</title><style>p{{}}</style></head><body><nav><a href=/>Home</a><a href=/x>News</a></nav>"
            "<div class='content'><h1>Title {0}</h1><p>Body &amp; text   number {0} goes here, quite long indeed.</p>"
            "<script>var x={0}</script></div><aside>Advert {0}</aside><footer>Imprint</footer></body></html>")
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(6)] + [(98, None, None), (99, "x", "")]
    got = {r.page_id: r for r in wrappers.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"Title {i} Body & text number {i} goes here, quite long indeed."
        assert got[i].n_chars == len(got[i].text)
    assert got[98].text == got[99].text == "" and len(got) == 8


# -- nulls, empty texts and tables, repeated rows, clashing names ---------------------

DOCS = [(1, "a short text", "en", "s"), (1, "a short text", "en", "s"), (2, None, None, None), (3, "", "en", None),
        (None, "no id here", None, "s"), (4, "word " * 20_000, "en", "t"), (5, "12 34", "en", "t")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ["id", "da", "key", "N_WORDS", "kept", "copy", "size", "rate", "score", "held_out", "doc", "digest", "host",
           "n_tokens", "start", "bands", "contaminated", "clean_text", "n", "label"]


def _odd(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        df = df.selectExpr("*", f"'mine' AS `{c}`")
    return df


OPERATORS = {
    "mix": lambda d, b: mixing.mix_sources(d),
    "decontaminate": decontaminate.find_contamination,
    "remove": lambda d, b: decontaminate.decontaminate(d, b),
    "spans": lambda d, b: decontaminate.decontaminate(d, b, remove="spans"),
    "quality": lambda d, b: quality.quality(d),
    "near": lambda d, b: neardup.near_duplicates(d),
    "representatives": lambda d, b: neardup.keep_representatives(d),
    "tokens": lambda d, b: tokens.tokenize_documents(d),
    "language": lambda d, b: langid.identify(langid.held_out(d), langid.language_model(d)),
    "sentences": lambda d, b: substrings.dedup_spans(d),
}
KEEPS_ROWS = {"decontaminate", "spans", "quality", "near", "tokens", "language", "sentences"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    bench = spark.createDataFrame([(None, "a short text"), ("x", None), ("y", ""), ("y", "")], "item_id string, text string")
    rows = OPERATORS[name](_odd(spark, DOCS), bench).collect()
    if name in KEEPS_ROWS:
        assert len(rows) == len(DOCS)
    if name == "representatives":
        assert len(rows) == len(DOCS) - 1  # the repeated row
    if name == "remove":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 2, 3, 4, 5]
    empty = OPERATORS[name](_odd(spark, DOCS).where("false"), bench.where("false"))
    assert empty.collect() == []


def test_odd_urls_and_conversations(spark):
    urls = spark.createDataFrame([(1, None), (1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Org/x?y#z")],
                                 "page_id long, url string").selectExpr("*", "1 AS host", "2 AS Verdict", "3 AS key")
    got = [tuple(r) for r in urlfilter.filter_urls(urls).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == [(1, "", "", None, "allow")] * 2 + [
        (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.org", "/x", "org/", "allow")]
    assert urlfilter.filter_urls(urls.where("false")).collect() == []
    turns = spark.createDataFrame(
        [(1, 1, "user", "hi"), (2, 1, "user", "hi"), (2, 2, None, None), (3, 1, "user", "hi"), (3, 2, None, None),
         (None, None, "user", "x" * 100_000), (4, 1, None, "")], "conv_id long, turn long, role string, text string") \
        .selectExpr("*", "1 AS id", "2 AS k", "3 AS n")
    rows = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert set(rows) == {2, None, 4} and rows[2].n_equal == 2 and rows[2].n_turns == 2
    assert rows[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_chats(turns.where("false")).collect() == []
    pages = urls.selectExpr("page_id", "url", "cast(null AS string) AS html", "1 AS text", "2 AS rules", "3 AS wrapper_host")
    assert [r.text for r in wrappers.extract_pages(pages).collect()] == [""] * 5
    assert wrappers.extract_pages(pages.where("false")).collect() == []
