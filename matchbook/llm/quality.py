"""Operator 5: quality rules, lines first.

Every line is judged by itself: it must end a sentence, must not be a menu
or boilerplate line and must not be littered with symbols. Failing lines go; a
document that loses too much of its text that way goes as well. Counts over the whole text
(repeated three-word windows, duplicate lines) stand beside it.

Scale: everything happens inside the row with built-in functions; the job is
one scan without an exchange, so no key, source or group can make it uneven.
Windows are compared by sorting 64-bit hashes with their positions, n log n in
the words of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import without

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 3
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
         "n_lines", "n_lines_removed", "kept_chars", "clean_text", "kept")


@dataclass(frozen=True)
class LineRules:
    """Patterns of one line and the share of the text that must remain."""

    terminal: str = "[.!?…。！？][\"'”’»)\\]]*\\s*$"
    navigation: str = r"(\S\s*[|»›•]\s*\S.*){2,}|(?i)^\s*(home|menu|next|previous|back to top|skip to content|read more|share this|log ?in|sign ?(in|up))\s*[.!>»|]*\s*$"
    boilerplate: str = r"(?i)\b(javascript|cookie policy|use of cookies|accept cookies|terms of (use|service)|privacy policy|all rights reserved|lorem ipsum|subscribe to our|click here)\b|[{}]"
    symbol: str = r"[^#*$%&|<>!?~^=_+{}@\\]+"
    symbols_a_word: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50
    min_kept_share: float = 0.5


def word_repeats(df: DataFrame, words: str = "__words") -> DataFrame:
    """Add ``n_repeat_words``; works on the array column ``words``."""
    n = F.size(words)
    at = lambda i, j: F.get(F.col(words), i + j)
    keys = F.transform(F.col(words), lambda w, i: F.xxhash64(w, at(i, 1), at(i, 2)))
    df = df.withColumn("__keys", F.when(n > WINDOW, F.slice(keys, F.lit(1), n - (WINDOW - 1)))
                       .otherwise(F.array().cast("array<bigint>")))
    # most clean texts repeat no window: the sort is for the others
    some = F.size(F.array_distinct("__keys")) < F.size("__keys")
    pairs = F.transform(F.col("__keys"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(some, F.sort_array(pairs))
                       .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, i, j: F.coalesce(x["h"] == F.get(F.col("__sorted"), i + j)["h"], F.lit(False))
    twice = F.filter(F.col("__sorted"), lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1)))
    spread = F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + j for j in range(WINDOW)])))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(spread)).cast("long")).drop("__keys", "__sorted")


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that the rules remove; lines without a word never fail."""
    words = F.size(F.filter(F.split(line, SPACE), lambda w: w != ""))
    symbols = F.length(F.regexp_replace(line, rules.symbol, ""))
    return (words > 0) & (~line.rlike(rules.terminal) | line.rlike(rules.navigation) | line.rlike(rules.boilerplate)
                          | (symbols > rules.symbols_a_word * words))


def quality(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Judge and clean every document; no row is dropped here.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, n_lines (lines with a word), n_lines_removed, kept_chars,
    clean_text (the lines that passed, joined by newlines) and kept; input
    columns of these names are replaced. ``kept`` is false for base_failed or
    if less than ``min_kept_share`` of the characters of words' lines remain.
    A null text counts as empty: it has no word and is base_failed. Repeated
    rows are judged alike; an empty table stays empty.
    """
    docs = without(docs, ADDED)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = (docs.withColumn("__words", F.filter(F.split(text, SPACE), lambda w: w != ""))
          .withColumn("__lines", F.filter(F.split(text, "\n"), lambda s: s.rlike(NOT_SPACE))))
    df = word_repeats(df)
    df = (df.withColumn("n_words", F.size("__words").cast("long"))
          .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
          .withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
          .withColumn("n_lines", F.size("__lines").cast("long"))
          .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
          .withColumn("__good", F.filter("__lines", lambda s: ~line_fails(s, rules))))
    df = (df.withColumn("n_lines_removed", (F.size("__lines") - F.size("__good")).cast("long"))
          .withColumn("clean_text", F.array_join("__good", "\n")))
    df = df.withColumn("kept_chars", F.length("clean_text").cast("long"))
    all_chars = F.length(F.array_join("__lines", "\n"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    enough = F.col("kept_chars") >= rules.min_kept_share * all_chars
    return df.withColumn("kept", ~F.col("base_failed") & enough).drop("__words", "__lines", "__good")


_LINE = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))"
ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             {_LINE} AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (VALUES (0), (1), (2)) v(j) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, lines,
        list_filter(lines, lambda s: regexp_matches(s, '{LineRules.terminal.replace("'", "''")}') AND NOT regexp_matches(s, '{LineRules.navigation}')
          AND NOT regexp_matches(s, '{LineRules.boilerplate}')
          AND length(regexp_replace(s, '{LineRules.symbol}', '', 'g')) <= {LineRules.symbols_a_word} * len(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))) AS good
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(lines)::BIGINT AS n_lines, (len(lines) - len(good))::BIGINT AS n_lines_removed,
  length(array_to_string(good, chr(10)))::BIGINT AS kept_chars,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND length(array_to_string(good, chr(10))) >= {LineRules.min_kept_share} * length(array_to_string(lines, chr(10))) AS kept
FROM b
"""
