"""Romanisation of non-Latin scripts as column expressions.

Letters of Cyrillic and Greek go by a table, full-width letters and further
Latin ones by their Unicode decomposition or name. The Indic scripts are
abugidas: a consonant has an inherent vowel ``a``, which a vowel sign replaces
and a virama removes. Their letters are spelled as Unicode names them (``LETTER
KHA`` is ``kha``, ``VOWEL SIGN II`` is ``ii``), so one rule serves all nine.

Texts without such letters skip the work.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# One Latin spelling for each letter, in the order of the alphabets.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёђєіїјљњћќўџґ",
                    "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch * y * e yu ya yo dj ye i yi j lj nj c kj u dz g".split()))
GREEK = dict(zip("αβγδεζηθικλμνξοπρςστυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
INDIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
SIGNS = {"ANUSVARA": "n", "CANDRABINDU": "n", "BINDI": "n", "TIPPI": "n", "VISARGA": "h", "NUKTA": "", "AVAGRAHA": ""}
RANGES = r"\x{100}-\x{24F}\x{250}-\x{2AF}\x{370}-\x{52F}\x{900}-\x{D7F}\x{1E00}-\x{1FFF}\x{FF01}-\x{FF5E}"

_NO_VOWEL = "\x01"  # takes the inherent vowel before it away


def _alphabets() -> dict[str, str]:
    """Small and capital letters of the alphabets, with and without accents."""
    table = {}
    for cp in [*range(0x100, 0x2B0), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        ch = chr(cp)
        base = next((x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)), "")
        latin = re.match(r"LATIN (?:SMALL|CAPITAL) LETTER (?:DOTLESS )?([A-Z])(?: WITH .*)?$", unicodedata.name(ch, ""))
        # a letter of its own comes before its base: й and ї have decompositions
        low = next((x[y] for y in (ch.lower(), base.lower()) for x in (CYRILLIC, GREEK) if y in x), None)
        if low is None and latin:
            low = latin[1].lower()
        if low is None and base.isascii() and len(unicodedata.normalize("NFKC", ch)) == 1 and base:
            table[ch] = base
        elif low is not None:
            low = low.replace("*", "")
            table[ch] = low if ch == ch.lower() else low[:1].upper() + low[1:]
    return table


def _abugidas() -> tuple[dict[str, str], dict[str, str], str, dict[str, str]]:
    """Consonants, vowel signs, viramas, and all other letters, signs and digits."""
    consonants, signs, viramas, others = {}, {}, "", {}
    for cp in range(0x900, 0xD80):
        name = unicodedata.name(chr(cp), "")
        m = re.match(rf"({'|'.join(INDIC)}) (LETTER|VOWEL SIGN|SIGN|DIGIT) (.+)", name)
        if not m:
            continue
        kind, own = m[2], m[3].split()[-1].lower()
        if kind == "DIGIT":
            others[chr(cp)] = str(unicodedata.digit(chr(cp)))
        elif kind == "VOWEL SIGN":
            signs[chr(cp)] = own
        elif kind == "SIGN" and m[3] == "VIRAMA":
            viramas += chr(cp)
        elif kind == "SIGN":
            others[chr(cp)] = SIGNS.get(m[3], "")
        elif own[0] not in "aeiou" and own.endswith("a"):
            consonants[chr(cp)] = own
        else:
            others[chr(cp)] = own
    return consonants, signs, viramas, others


ALPHABETS = _alphabets()
CONSONANTS, VOWEL_SIGNS, VIRAMAS, OTHERS = _abugidas()
SPELLINGS = ALPHABETS | CONSONANTS | {k: _NO_VOWEL + v for k, v in VOWEL_SIGNS.items()} | dict.fromkeys(VIRAMAS, _NO_VOWEL) | OTHERS
_ONE = {k: v for k, v in SPELLINGS.items() if len(v) == 1}
_MORE = {k: v for k, v in SPELLINGS.items() if len(v) != 1}


def romanise(c: Column) -> Column:
    """Latin spelling of the scripts above; everything else stays as it is.

    Letters that become one letter are translated in one pass, the others are
    looked up one by one: few nodes, so that the expression still compiles with what is around it.
    """
    table = F.create_map(*[F.lit(x) for pair in _MORE.items() for x in pair])
    t = F.translate(c, "".join(_ONE), "".join(_ONE.values()))
    t = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(c.rlike(f"[{RANGES}]"), F.regexp_replace(t, f"a{_NO_VOWEL}|{_NO_VOWEL}", "")).otherwise(c)


def unmapped_letters(c: Column) -> Column:
    """Letters beyond ASCII that the fold to ASCII would delete."""
    return F.regexp_count(c, F.lit(r"[\p{L}&&[^\x00-\x7F]]")).cast("long")
