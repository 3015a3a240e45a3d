"""Line deduplication against DuckDB, brute force and odd rows."""

from collections import defaultdict

from conftest import SF0001
from matchbook.llm import lines
from matchbook.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows, min_docs=lines.MIN_DOCS, min_chars=lines.MIN_CHARS):
    """rows: (doc_id, text); kept text, lines and dropped lines of each row."""
    def name(doc, text):
        return (1, doc) if doc is not None else (0, text or "")

    def key(line):
        k = line.strip(SPACE).translate(AZ)
        return k if len(k) >= min_chars else None

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add(name(doc, text))
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if key(x) is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == name(doc, text)]
        out.append((doc, None if text is None else "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


def _as_rows(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_brute_force_and_a_lower_threshold(spark):
    docs = table(spark, SF0001, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_docs, min_chars in ((5, 40), (2, 10)):
        want = _brute(rows, min_docs, min_chars)
        assert _as_rows(lines.dedup_lines(docs, min_docs, min_chars)) == sorted(want, key=str)
        assert sum(w[3] for w in want)


def test_odd_rows(spark):
    hot = "The same footer line stands below every one of these pages."
    odd = "é" * 39 + "x"
    rows = [(i, f"own line {i}\n  {hot.upper()} \r\n{hot}") for i in range(300)]
    rows += [(None, hot), (None, hot + "\nmore"), (None, hot), (7, hot), (7, None), (8, ""), (9, "\n\n"), (None, None)]
    rows += [(1000 + i, odd + ("\v" if i % 2 else "")) for i in range(5)] + [(2000 + i, "é" * 39) for i in range(6)]
    rows += [(3000, "\n".join([hot] * 20_000)), (3000, hot)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, N_LINES int, own string").repartition(5)
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "own", "n_lines", "n_dropped"]
    want = _brute(rows)
    assert _as_rows(got) == sorted(want, key=str)
    assert (3000, hot, 1, 0) in want and (8, "", 1, 0) in want


def test_only_rows_without_ids(spark):
    hot = "A line that stands in many documents without any name at all"
    rows = [(None, f"{i}\n{hot}") for i in range(8)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == 7


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).collect() == []
