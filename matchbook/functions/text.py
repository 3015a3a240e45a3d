"""Text normalisation as Catalyst column expressions (no Python in the hot path).

Every function maps ``Column -> Column`` so it composes inside one
``select``/``withColumns`` and stays in whole-stage codegen.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ADDR_ABBREV, LEGAL_SUFFIXES, NAME_ABBREV, NAME_STOPWORDS
from .romanise import romanise

# ---------------------------------------------------------------------------
# ASCII folding
# ---------------------------------------------------------------------------

# Latin letters with diacritics fold to their base letter. The table is built
# from a rule (Unicode compatibility decomposition) rather than typed out.
_FOLD_RANGES = [(0x00C0, 0x024F), (0x1E00, 0x1EFF)]


def _build_fold_table() -> tuple[str, str]:
    src, dst = [], []
    for lo, hi in _FOLD_RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            dec = unicodedata.normalize("NFKD", ch)
            base = dec[:1]
            rest = dec[1:]
            if (len(dec) > 1 and base.isascii() and base.isalpha()
                    and all(unicodedata.combining(r) for r in rest)):
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


FOLD_SRC, FOLD_DST = _build_fold_table()

# Letters without a decomposition that fold to one or two ASCII letters.
FOLD_MULTI = [
    ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"),
    ("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"),
    ("þ", "th"), ("Þ", "Th"), ("ð", "d"), ("Ð", "D"),
]

# Non-ASCII spaces, punctuation and symbols become a space (they separate
# words); any other non-ASCII code point left after folding is dropped.
NON_ASCII_SEP = r"[\x{80}-\x{BF}\x{2000}-\x{2BFF}\x{3000}-\x{303F}]"
NON_ASCII = r"[^\x00-\x7F]"


def ascii_fold(c: Column) -> Column:
    """Fold text to ASCII (T01): other scripts are romanised first. ASCII rows skip the work entirely."""
    t = F.translate(romanise(c), FOLD_SRC, FOLD_DST)
    for a, b in FOLD_MULTI:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, NON_ASCII_SEP, " ")
    t = F.regexp_replace(t, NON_ASCII, "")
    return F.when(c.rlike(NON_ASCII), t).otherwise(c)


# ---------------------------------------------------------------------------
# Small helpers
# ---------------------------------------------------------------------------

def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` on ASCII text."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def _lookup(mapping: dict[str, str]) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def _regex_literal(s: str) -> str:
    # Suffixes contain letters, spaces, '&' and '.'; only '.' is special.
    return s.replace(".", r"\.")


SUFFIX_PASS_REVERSED = "(?i)^" + "".join(
    r"(?:\s*\.?" + _regex_literal(s[::-1]) + r"\b[,\s]*)?" for s in LEGAL_SUFFIXES)
PHONE_PATTERN = r"(?i)\b(ph\.?\s*)?\d{6,}\b"
PUNCT_PATTERN = r"[^\w\s]"
ZIP5_PATTERN = r"\b(\d{5})(?:-\d{4})?\b"
PIN6_PATTERN = r"\b(\d{6})\b"


# ---------------------------------------------------------------------------
# Names and addresses
# ---------------------------------------------------------------------------

def strip_legal_suffixes(c: Column) -> Column:
    """One ordered pass over the suffix list in any letter case, each anchored at the end.

    Equivalent to applying ``[,\\s]*\\b<suffix>\\.?\\s*$`` for each suffix in
    order, then trimming ``,. ``. The work runs on the reversed string, where
    each pattern is anchored at the current start: the ordered pass becomes
    one regex ``^(?:P1)?(?:P2)?…(?:P43)?`` evaluated once per row. Each
    optional group is tried in order, takes its match when there is one, and
    is never backtracked into (the rest always matches), which is exactly the
    sequential pass. ``\\b`` is symmetric and the leftmost forward match
    equals the greedy reversed match, so results are identical.
    """
    t = F.regexp_replace(F.reverse(strip_ws(c)), SUFFIX_PASS_REVERSED, "")
    return F.regexp_replace(F.reverse(t), r"^[,. ]+|[,. ]+$", "")


def normalize_name(raw: Column) -> Column:
    """fold -> lower -> strip suffixes -> punctuation -> expand -> stopwords."""
    t = strip_ws(F.lower(ascii_fold(F.coalesce(raw, F.lit("")))))
    t = strip_legal_suffixes(t)
    t = F.regexp_replace(t, PUNCT_PATTERN, " ")
    abbrev = _lookup(NAME_ABBREV)
    toks = F.transform(tokens(t), lambda x: F.coalesce(F.try_element_at(abbrev, x), x))
    toks = F.filter(toks, lambda x: ~x.isin(*NAME_STOPWORDS))
    return F.array_join(toks, " ")


def strip_phone(c: Column) -> Column:
    """Phone numbers (six or more digits, optional 'ph.') become a space."""
    return F.regexp_replace(c, PHONE_PATTERN, " ")


def normalize_address(raw: Column) -> Column:
    """fold -> lower -> phones -> punctuation -> expand -> drop 1-char non-digits."""
    t = strip_ws(F.lower(ascii_fold(F.coalesce(raw, F.lit("")))))
    t = strip_phone(t)
    t = F.regexp_replace(t, PUNCT_PATTERN, " ")
    abbrev = _lookup(ADDR_ABBREV)
    toks = F.transform(tokens(t), lambda x: F.coalesce(F.try_element_at(abbrev, x), x))
    toks = F.filter(toks, lambda x: (F.length(x) > 1) | x.rlike("^[0-9]$"))
    return F.array_join(toks, " ")


def zip_pin(norm_address: Column) -> Column:
    """First 5-digit ZIP (ZIP+4 allowed), else first 6-digit PIN, else '' (T06)."""
    a = F.coalesce(norm_address, F.lit(""))
    z5 = F.regexp_extract(a, ZIP5_PATTERN, 1)
    return F.when(z5 != "", z5).otherwise(F.regexp_extract(a, PIN6_PATTERN, 1))


def name_prefix(norm_name: Column, n: int = 3) -> Column:
    """First ``n`` tokens."""
    return F.array_join(F.slice(tokens(norm_name), 1, n), " ")


def name_suffix(norm_name: Column, n: int = 2) -> Column:
    """Last ``n`` tokens, all of them when fewer."""
    t = tokens(norm_name)
    return F.array_join(F.slice(t, F.greatest(F.size(t) - n + 1, F.lit(1)), n), " ")


def fold_country(c: Column) -> Column:
    """Country as a key part: lower + strip, null -> '' (T14)."""
    return F.coalesce(strip_ws(F.lower(c)), F.lit(""))


def valid_zip(zip_col: Column, norm_address: Column) -> Column:
    """ZIP only when non-empty and not the first address token."""
    a0 = F.try_element_at(tokens(F.coalesce(norm_address, F.lit(""))), F.lit(1))
    ok = zip_col.isNotNull() & (zip_col != "") & (a0.isNull() | (zip_col != a0))
    return F.when(ok, zip_col)


def count_ids(c: Column) -> Column:
    """Matches in a comma list: 0 for null/'' else number of comma parts."""
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.size(F.split(c, ",")))


def parse_id_list(c: Column) -> Column:
    """Comma list -> distinct trimmed non-blank ids."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


RAW_ZIP_OR_PIN = r"(?U)\b\d{5}(?:-\d{4})?\b|\b\d{6}\b"


def has_zip_or_pin(raw_address: Column) -> Column:
    """Raw-text ZIP or PIN presence with Unicode-aware classes."""
    return raw_address.rlike(RAW_ZIP_OR_PIN)


def url_name_fold(c: Column) -> Column:
    """Strip scheme, 'www.' and the final top-level domain from a URL-like name."""
    t = F.lower(strip_ws(c))
    t = F.regexp_replace(t, r"^[a-z][a-z0-9+.-]*://", "")
    t = F.regexp_replace(t, r"^www\.", "")
    t = F.regexp_replace(t, r"[/?#].*$", "")
    t = F.regexp_replace(t, r":\d+$", "")
    return F.regexp_replace(t, r"\.[a-z]{2,}$", "")
