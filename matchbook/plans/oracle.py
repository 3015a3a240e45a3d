"""DuckDB SQL builders for the independent oracle.

Each query registered in ``__spark_entry__`` has an ANSI/DuckDB SQL twin
written here from the same specification, not from the Spark code path: the
oracle uses brute force where the Spark job uses a scalable rewrite (e.g. the
blocking cap is checked against the full, untruncated join).
"""

from __future__ import annotations

from matchbook.functions.constants import (
    ADDR_ABBREV, COMMON_ADDR_TOKENS, LEGAL_SUFFIXES, NAME_ABBREV, NAME_STOPWORDS,
    SKIP_ADDR_V4,
)
from matchbook.functions.text import FOLD_MULTI, NON_ASCII, NON_ASCII_SEP
from matchbook.sources.records import RECORDS_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def fold(x: str) -> str:
    t = f"strip_accents({x})"
    for a, b in FOLD_MULTI:
        t = f"replace({t}, {q(a)}, {q(b)})"
    t = f"regexp_replace({t}, '{NON_ASCII_SEP}', ' ', 'g')"
    return f"regexp_replace({t}, '{NON_ASCII}', '', 'g')"


def split_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda z: z <> '')"


def case_map(var: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {var} {whens} ELSE {var} END"


def strip_suffixes(x: str) -> str:
    t = strip_ws(x)
    for s in LEGAL_SUFFIXES:
        pat = "[,\\s]*\\b" + s.replace(".", "\\.") + "\\.?\\s*$"
        t = strip_ws(f"regexp_replace({t}, {q(pat)}, '')")
    return f"trim({t}, ',. ')"


def norm_name(x: str) -> str:
    t = strip_ws(f"lower({fold(f'coalesce({x}, {q(str())})')})")
    t = strip_suffixes(t)
    t = f"regexp_replace({t}, '[^\\w\\s]', ' ', 'g')"
    toks = f"list_transform({split_tokens(t)}, lambda w: {case_map('w', NAME_ABBREV)})"
    toks = f"list_filter({toks}, lambda w: w NOT IN {in_list(NAME_STOPWORDS)})"
    return f"array_to_string({toks}, ' ')"


def strip_phone(x: str) -> str:
    return f"regexp_replace({x}, '(?i)\\b(ph\\.?\\s*)?\\d{{6,}}\\b', ' ', 'g')"


def norm_address(x: str) -> str:
    t = strip_ws(f"lower({fold(f'coalesce({x}, {q(str())})')})")
    t = strip_phone(t)
    t = f"regexp_replace({t}, '[^\\w\\s]', ' ', 'g')"
    toks = f"list_transform({split_tokens(t)}, lambda w: {case_map('w', ADDR_ABBREV)})"
    toks = f"list_filter({toks}, lambda w: length(w) > 1 OR regexp_full_match(w, '[0-9]'))"
    return f"array_to_string({toks}, ' ')"


def zip_pin(a: str) -> str:
    z5 = f"regexp_extract({a}, '\\b(\\d{{5}})(?:-\\d{{4}})?\\b', 1)"
    return f"CASE WHEN {z5} <> '' THEN {z5} ELSE regexp_extract({a}, '\\b(\\d{{6}})\\b', 1) END"


def records_cte() -> str:
    """``records`` CTE body (portable fixture SQL) for DuckDB."""
    return RECORDS_SQL.format(customer="customer", orders="orders")


def norm_cte() -> str:
    """``WITH records AS (...), norm0 AS (...), norm AS (...)`` prefix."""
    return f"""WITH records AS ({records_cte()}),
norm0 AS (
  SELECT *, {norm_name('business_name')} AS norm_name,
         {norm_address('business_address')} AS norm_address
  FROM records),
norm AS (
  SELECT *, {zip_pin('norm_address')} AS zip_pin,
    array_to_string({split_tokens('norm_name')}[1:3], ' ') AS name_prefix,
    array_to_string(CASE WHEN len({split_tokens('norm_name')}) >= 2
                         THEN {split_tokens('norm_name')}[-2:]
                         ELSE {split_tokens('norm_name')} END, ' ') AS name_suffix
  FROM norm0)"""


# ---------------------------------------------------------------------------
# Blocking keys (B01–B15) written as one SELECT per key type
# ---------------------------------------------------------------------------

KEY_PRIORITY_SQL = {
    "n3": 1, "n2": 2, "n1": 3, "fl": 4, "sfx2": 5, "zip": 6,
    "addr_12": 7, "addr_m": 7, "addr_23": 8, "addr_s": 8, "addr_e": 9, "n1all": 10,
}


def _ln(x: str) -> str:
    return f"coalesce(length({x}), 0)"


def keys_cte(version: str) -> str:
    """``kc`` (key columns) and ``keys(entity_id, src, tag, key)`` CTEs after ``norm``."""
    nt = split_tokens("norm_name")
    at = split_tokens("norm_address")
    kc = f"""kc AS (
  SELECT entity_id, src, coalesce({strip_ws('lower(country)')}, '') AS cty,
    {nt} AS ntk, {at} AS atk,
    list_filter({nt}, lambda z: length(z) >= 2) AS sig,
    list_filter({at}, lambda z: length(z) >= 3 AND z NOT IN {in_list(COMMON_ADDR_TOKENS)}) AS sat,
    CASE WHEN zip_pin <> '' AND ({at}[1] IS NULL OR zip_pin <> {at}[1]) THEN zip_pin END AS zipv
  FROM norm)"""
    sel = []

    def add(tag, cond, *parts):
        sel.append(f"SELECT entity_id, src, '{tag}' AS tag, concat_ws('|', cty, {', '.join(parts)}) AS key "
                   f"FROM kc WHERE {cond}")

    if version in ("v1", "v2"):
        n = "len(sig)"
        add("n2", f"{n} >= 2", "sig[1]", "sig[2]")
        if version == "v1":
            add("n1", f"{n} = 1", "sig[1]")
        else:
            add("n1all", f"{n} >= 1", "sig[1]")
        add("sfx2", f"{n} >= 3", "sig[-2]", "sig[-1]")
        add("fl", f"{n} >= 3", "sig[1]", "sig[-1]")
        add("n3", f"{n} >= 3", "sig[1]", "sig[2]", "sig[3]")
        add("zip", "zipv IS NOT NULL", "zipv")
        if version == "v2":
            add("addr_m", "len(sat) >= 4", "sat[3]", "sat[4]")
            add("addr_s", "len(sat) >= 3", "sat[2]", "sat[3]")
            add("addr_e", "len(sat) >= 4", "sat[-3]", "sat[-2]")
    else:
        skip = in_list(SKIP_ADDR_V4)

        def nm(*xs):
            return " AND ".join(f"{_ln(x)} >= 2" for x in xs)

        def ad(*xs):
            return " AND ".join(f"{_ln(x)} >= 3 AND {x} NOT IN {skip}" for x in xs)

        add("n2", nm("ntk[1]", "ntk[2]"), "ntk[1]", "ntk[2]")
        add("n1all", nm("ntk[1]"), "ntk[1]")
        add("sfx2", f"len(ntk) >= 3 AND {nm('ntk[-2]', 'ntk[-1]')}", "ntk[-2]", "ntk[-1]")
        add("fl", f"len(ntk) >= 3 AND {nm('ntk[1]', 'ntk[-1]')}", "ntk[1]", "ntk[-1]")
        add("n3", f"len(ntk) >= 3 AND {nm('ntk[1]', 'ntk[2]', 'ntk[3]')}", "ntk[1]", "ntk[2]", "ntk[3]")
        add("zip", "zipv IS NOT NULL", "zipv")
        add("addr_12", ad("atk[2]", "atk[3]"), "atk[2]", "atk[3]")
        add("addr_23", ad("atk[3]", "atk[4]"), "atk[3]", "atk[4]")
        add("addr_e", f"len(atk) >= 5 AND {ad('atk[-3]', 'atk[-2]')}", "atk[-3]", "atk[-2]")
    prio = case_map("tag", {k: str(v) for k, v in KEY_PRIORITY_SQL.items()})
    return kc + ",\nkeys AS (\n  " + "\n  UNION ALL ".join(sel) + f"),\nkeysp AS (SELECT *, CAST({prio} AS INTEGER) AS prio FROM keys)"


def truth_cte() -> str:
    return """truth AS (
  SELECT s.entity_id AS s1_id, t.entity_id AS cand_id
  FROM records s JOIN records t ON s.truth_key = t.truth_key
  WHERE s.src = 1 AND t.src <> 1)"""


def block_cte(version: str, cap: int) -> str:
    """Brute-force blocking: full join, dedup, rank; ``blk`` keeps rank ≤ cap+1."""
    return f"""{norm_cte()},
{keys_cte(version)},
{truth_cte()},
j AS (
  SELECT s.entity_id AS s1_id, t.entity_id AS cand_id, s.tag, s.prio
  FROM keysp s JOIN keysp t ON s.tag = t.tag AND s.key = t.key
  WHERE s.src = 1 AND t.src <> 1 AND s.entity_id <> t.entity_id),
p AS (SELECT s1_id, cand_id, arg_min(tag, prio) AS best_key, min(prio) AS prio FROM j GROUP BY s1_id, cand_id),
blk_all AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prio, md5(cand_id), cand_id) AS rank FROM p),
blk AS (SELECT s1_id, cand_id, best_key, rank FROM blk_all WHERE rank <= {cap}),
s1 AS (SELECT entity_id FROM records WHERE src = 1),
counts AS (
  SELECT s1.entity_id AS s1_id, count(b.cand_id) FILTER (WHERE b.rank <= {cap}) AS n,
         coalesce(bool_or(b.rank > {cap}), false) AS capped
  FROM s1 LEFT JOIN (SELECT * FROM blk_all WHERE rank <= {cap} + 1) b ON s1.entity_id = b.s1_id
  GROUP BY s1.entity_id)"""


# ---------------------------------------------------------------------------
# Pair features, scores, F0.5
# ---------------------------------------------------------------------------

def _grams(s: str) -> str:
    return (f"CASE WHEN length({s}) >= 3 THEN list_distinct(list_transform(range(1, length({s}) - 1), "
            f"lambda i: substr({s}, i, 3))) WHEN length({s}) > 0 THEN [{s}] ELSE []::VARCHAR[] END")


def _jac(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {u} > 0 THEN round(len(list_intersect({a}, {b})) / {u}, 6) ELSE 0.0 END"


def _lev(a: str, b: str) -> str:
    m = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {m} > 0 THEN round(1 - levenshtein({a}, {b}) / {m}, 6) ELSE 0.0 END"


def _tset(s: str) -> str:
    return f"list_distinct({split_tokens(f'coalesce({s}, {q(str())})')})"


def _tsort(s: str) -> str:
    return f"array_to_string(list_sort({split_tokens(s)}), ' ')"


def _firstnum(s: str) -> str:
    return f"list_filter({split_tokens(s)}, lambda x: regexp_full_match(x, '[0-9]+'))[1]"


def _comps(s: str) -> str:
    return (f"list_distinct(list_filter(list_transform(string_split(lower({s}), ','), lambda x: trim(x)), "
            f"lambda x: x <> ''))")


def soundex(x: str) -> str:
    """American Soundex of a token: H and W are passed over, vowels and other characters part equal codes."""
    codes = f"translate(regexp_replace(upper({x}), '[^A-Z]', 'A', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    runs = f"substr({codes}, 1, 1) || replace(substr({codes}, 2), '7', '')"
    for d in "123456":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    code = f"rpad(substr(replace(substr({runs}, 2), '0', ''), 1, 3), 3, '0')"
    return f"CASE WHEN regexp_matches({x}, '^[A-Za-z]') THEN upper(substr({x}, 1, 1)) || {code} ELSE {x} END"


def pair_features_cte(cap: int = 300) -> str:
    """``blk`` pairs with both sides' attributes and all features as ``pf``."""
    ta, tb = split_tokens("na"), split_tokens("nb")
    prefix = (f"CAST(coalesce(list_position(list_transform(range(1, greatest(len({ta}), len({tb})) + 1), "
              f"lambda i: coalesce(({ta})[i] = ({tb})[i], false)), false) - 1, len({ta})) AS BIGINT)")
    return f"""{block_cte('v4', cap)},
pa AS (
  SELECT b.s1_id, b.cand_id, a.norm_name AS na, c.norm_name AS nb, a.norm_address AS aa, c.norm_address AS ab,
    a.zip_pin AS za, c.zip_pin AS zb, a.country AS ca, c.country AS cb, a.business_address AS ra, c.business_address AS rb
  FROM blk b JOIN norm a ON a.entity_id = b.s1_id JOIN norm c ON c.entity_id = b.cand_id),
pf AS (
  SELECT s1_id, cand_id, na, nb, aa, ab,
    {_jac(_grams('na'), _grams('nb'))} AS name_char3_jaccard,
    {_jac(_tset('na'), _tset('nb'))} AS name_token_jaccard,
    {_lev('na', 'nb')} AS name_lev_ratio,
    {_lev(_tsort('na'), _tsort('nb'))} AS token_sort_ratio,
    {prefix} AS prefix_tokens,
    CAST(({soundex(f'({ta})[1]')}) = ({soundex(f'({tb})[1]')}) AS INTEGER) AS name_phonetic_match,
    CASE WHEN za <> '' AND zb <> '' THEN CAST(za = zb AS INTEGER) END AS zip_match,
    CASE WHEN {_firstnum('aa')} IS NOT NULL AND {_firstnum('ab')} IS NOT NULL
         THEN CAST({_firstnum('aa')} = {_firstnum('ab')} AS INTEGER) END AS street_no_match,
    CASE WHEN aa <> '' AND ab <> '' THEN {_jac(_tset('aa'), _tset('ab'))} END AS addr_token_jaccard,
    CASE WHEN aa <> '' AND ab <> '' THEN {_lev('aa', 'ab')} END AS addr_lev_ratio,
    CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN CAST(len(list_intersect({_comps('ra')}, {_comps('rb')})) AS BIGINT) END
      AS addr_component_overlap,
    CAST(coalesce({strip_ws('lower(ca)')}, '') = coalesce({strip_ws('lower(cb)')}, '') AS INTEGER) AS country_match,
    CASE WHEN greatest(length(na), length(nb)) > 0
         THEN round(least(length(na), length(nb)) / greatest(length(na), length(nb)), 6) ELSE 0.0 END AS name_len_ratio,
    CAST(aa <> '' AND ab <> '' AS INTEGER) AS both_address
  FROM pa),
ps AS (
  SELECT *, CASE WHEN both_address = 1 THEN 0.5 * name_char3_jaccard + 0.3 * token_sort_ratio + 0.2 * addr_token_jaccard
                 ELSE (0.5 * name_char3_jaccard + 0.3 * token_sort_ratio) / 0.8 END AS score
  FROM pf)"""


def f05_expr(tp: str, n_pred: str, n_true: str) -> str:
    p = f"(CASE WHEN {n_pred} > 0 THEN {tp} / {n_pred} ELSE 0.0 END)"
    r = f"(CASE WHEN {n_true} > 0 THEN {tp} / {n_true} ELSE 0.0 END)"
    f = f"(CASE WHEN 0.25 * {p} + {r} > 0 THEN 1.25 * {p} * {r} / (0.25 * {p} + {r}) ELSE 0.0 END)"
    return f"(CASE WHEN {n_true} = 0 THEN (CASE WHEN {n_pred} = 0 THEN 1.0 ELSE 0.0 END) ELSE {f} END)"
