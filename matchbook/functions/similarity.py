"""Pair similarity functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchbook.functions.text import tokens


def _empty() -> Column:
    return F.array().cast("array<string>")


def char_grams(s: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a non-empty string shorter than n is its own gram."""
    L = F.length(s)
    grams = F.transform(F.sequence(F.lit(1), L - n + 1), lambda i: s.substr(i, F.lit(n)))
    return (F.when(L >= n, F.array_distinct(grams))
            .when(L > 0, F.array(s)).otherwise(_empty()))


def gram_codes(s: Column) -> Column:
    """The 3-grams of ``char_grams`` as distinct numbers of 21 bits a character: to compare two arrays costs a third."""
    at = lambda i: F.when(F.length(s) >= i, F.ascii(s.substr(i, F.lit(1))).cast("long") + 1).otherwise(F.lit(0))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))),
                        lambda i: at(i) * (1 << 42) + at(i + 1) * (1 << 21) + at(i + 2))
    return F.when(F.length(s) > 0, F.array_distinct(codes)).otherwise(F.array().cast("array<bigint>"))


def token_set(s: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(s, F.lit(""))))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| over distinct arrays; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.round(F.try_divide(both, F.size(a) + F.size(b) - both), 6), F.lit(0.0))


def lev_ratio(a: Column, b: Column) -> Column:
    """1 − levenshtein / longer length; 0 when both are empty."""
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m > 0, F.round(1 - F.levenshtein(a, b) / m, 6)).otherwise(F.lit(0.0))


def token_sort(s: Column) -> Column:
    return F.array_join(F.array_sort(tokens(F.coalesce(s, F.lit("")))), " ")


def common_prefix_tokens(a: Column, b: Column) -> Column:
    """Length of the common leading token run."""
    return common_prefix(tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit(""))))


def common_prefix(ta: Column, tb: Column) -> Column:
    """Length of the common beginning of two arrays."""
    eq = F.zip_with(ta, tb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    pos = F.array_position(eq, False)
    return F.when(pos == 0, F.size(ta)).otherwise(pos - 1).cast("long")


def first_number(norm_address: Column) -> Column:
    return F.try_element_at(F.filter(tokens(F.coalesce(norm_address, F.lit(""))),
                                     lambda x: x.rlike("^[0-9]+$")), F.lit(1))


def address_components(raw: Column) -> Column:
    parts = F.transform(F.split(F.lower(raw), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


_TAKEN = "\x01"  # stands for a matched character


def jaro_winkler(a: Column, b: Column, weight: float = 0.1, boost_above: float = 0.7) -> Column:
    """Jaro-Winkler similarity (prefix weight 0.1, at most 4 characters, boost above 0.7), six places.

    One fold over the characters of ``a``: each takes the first equal character of ``b`` that is
    near enough and not taken yet. Half the transpositions are counted with integer division.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    n1, n2 = F.length(a), F.length(b)
    near = F.greatest(F.floor(F.greatest(n1, n2) / 2).cast("int") - 1, F.lit(0))
    one = F.lit(1)

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use(value)`` with the value computed once: written out, it would be again wherever ``use`` names it."""
        return F.transform(F.array(value), use)[0]

    def take(s: Column, i: Column) -> Column:
        low = F.greatest(i - s["near"], one)
        part = s["rest"].substr(low, F.greatest(i + s["near"] - low + 1, F.lit(0)))
        return once(F.call_function("instr", part, a.substr(i, one)), lambda at: F.when(at > 0, F.struct(
            F.overlay(s["rest"], F.lit(_TAKEN), low + at - 1, one).alias("rest"),
            F.concat(s["found"], a.substr(i, one)).alias("found"), s["near"].alias("near"))).otherwise(s))

    def jaro(s: Column) -> Column:
        taken = F.array_join(F.filter(F.split(b, ""), lambda _, i: s["rest"].substr(i + 1, one) == _TAKEN), "")
        swapped = once(taken, lambda other: F.size(F.filter(F.sequence(one, F.length(other)), lambda i: s["found"].substr(i, one) != other.substr(i, one))))
        m = F.length(s["found"])
        return F.when(m > 0, (m / n1 + m / n2 + (m - F.floor(swapped / 2)) / m) / 3).otherwise(F.lit(0.0))

    alike = F.lit(0)
    for k in range(1, 5):  # the common prefix
        alike = F.when((F.least(n1, n2) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), F.lit(k)).otherwise(alike)
    start = F.struct(b.alias("rest"), F.lit("").alias("found"), near.alias("near"))
    j = F.when((n1 > 0) & (n2 > 0), F.aggregate(F.sequence(one, F.greatest(n1, one)), start, take, jaro)).otherwise(F.lit(0.0))
    boosted = F.transform(F.array(j), lambda x: F.when(x > boost_above, x + alike * weight * (1 - x)).otherwise(x))
    return F.round(boosted[0], 6)


def soundex_first(s: Column) -> Column:
    """Soundex of the first token, null without one."""
    return F.soundex(F.try_element_at(tokens(F.coalesce(s, F.lit(""))), F.lit(1)))
