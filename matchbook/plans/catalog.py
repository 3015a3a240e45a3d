"""Registry of named queries: a Spark job and (where exact) its DuckDB oracle.

Every query reads the driver's tables (through the derived record fixture or
directly) so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions import text as tx
from matchbook.functions.constants import MAX_CANDIDATES_V1, MAX_CANDIDATES_V2, MAX_CANDIDATES_V4
from matchbook.operators import blocking as bl
from matchbook.operators import evaluate as ev
from matchbook.operators.keys import explode_keys, key_stats
from matchbook.operators.normalize import normalize_records, normalize_stats
from matchbook.plans import oracle as O
from matchbook.session import written
from matchbook.sources import records as rs

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

CAPS = {"v1": MAX_CANDIDATES_V1, "v2": MAX_CANDIDATES_V2, "v4": MAX_CANDIDATES_V4}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------

def norm(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised records, materialised once per input folder (stage boundary)."""
    from matchbook.plans.stages import stage
    return stage(spark, "normalized", sf, ["customer", "orders"],
                 lambda: normalize_records(rs.records(spark, sf)))


def split_norm(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = norm(spark, sf)
    return n.where(F.col("src") == 1), n.where(F.col("src") != 1)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return rs.truth_long(rs.records(spark, sf))


def blocked(spark: SparkSession, sf: str, version: str, cap: int | None = None,
            with_overflow: bool = False, listed: bool = False) -> DataFrame:
    s1, tg = split_norm(spark, sf)
    return bl.block(s1, tg, version, CAPS[version] if cap is None else cap, with_overflow, listed)


REC = f"WITH records AS ({O.records_cte()})"

# ---------------------------------------------------------------------------
# Sources (S01–S09, U01)
# ---------------------------------------------------------------------------

register("scan_records", f"{REC} SELECT * FROM records")(
    lambda spark, sf: rs.records(spark, sf))

register("union_targets", f"{REC} SELECT entity_id, src, business_name, business_address, country "
                          "FROM records WHERE src = 2 UNION ALL SELECT entity_id, src, business_name, "
                          "business_address, country FROM records WHERE src = 3")(
    lambda spark, sf: rs.targets(rs.records(spark, sf)).select(
        "entity_id", "src", "business_name", "business_address", "country"))

register("source_of_id", f"{REC} SELECT entity_id, CASE WHEN regexp_matches(entity_id, '^S[123]-') "
                         "THEN substr(entity_id, 1, 2) END AS source FROM records")(
    lambda spark, sf: rs.records(spark, sf).select("entity_id", rs.source_of(F.col("entity_id")).alias("source")))

_TRUTH_WIDE_SQL = f"""{REC}, {O.truth_cte()}
SELECT r.entity_id AS source1_entity_id, l.matched_entity_ids
FROM records r LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS matched_entity_ids
                          FROM truth GROUP BY s1_id) l ON r.entity_id = l.s1_id
WHERE r.src = 1"""
register("truth_wide", _TRUTH_WIDE_SQL)(lambda spark, sf: rs.truth_wide(rs.records(spark, sf)))

register("truth_long", f"""WITH tw AS ({_TRUTH_WIDE_SQL})
SELECT DISTINCT trim(source1_entity_id) AS s1_id, trim(x) AS cand_id
FROM tw, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS u(x) WHERE trim(x) <> ''""")(
    lambda spark, sf: rs.parse_truth(rs.truth_wide(rs.records(spark, sf))))

register("required_ids", f"{REC} SELECT DISTINCT trim(entity_id) AS entity_id FROM records WHERE src = 1")(
    lambda spark, sf: rs.source1(rs.records(spark, sf)).select(F.trim("entity_id").alias("entity_id")).distinct())

# ---------------------------------------------------------------------------
# Text functions
# ---------------------------------------------------------------------------

register("normalized_records", f"""{O.norm_cte()}
SELECT entity_id, src, country, norm_name, norm_address, zip_pin, name_prefix, name_suffix FROM norm""")(
    lambda spark, sf: norm(spark, sf).select("entity_id", "src", "country", "norm_name", "norm_address",
                                             "zip_pin", "name_prefix", "name_suffix"))

register("ascii_fold", f"SELECT doc_id, {O.fold('text')} AS folded FROM documents")(
    lambda spark, sf: rs.table(spark, sf, "documents").select("doc_id", tx.ascii_fold(F.col("text")).alias("folded")))

register("strip_suffix", f"""{REC}
SELECT entity_id, {O.strip_suffixes(O.strip_ws(f"lower({O.fold('business_name')})"))} AS stripped FROM records""")(
    lambda spark, sf: rs.records(spark, sf).select(
        "entity_id", tx.strip_legal_suffixes(tx.strip_ws(F.lower(tx.ascii_fold(F.col("business_name")))))
        .alias("stripped")))

register("strip_phone", f"""{REC}
SELECT entity_id, {O.strip_phone(O.strip_ws(f"lower({O.fold('business_address')})"))} AS no_phone
FROM records WHERE business_address IS NOT NULL""")(
    lambda spark, sf: rs.records(spark, sf).where(F.col("business_address").isNotNull()).select(
        "entity_id", tx.strip_phone(tx.strip_ws(F.lower(tx.ascii_fold(F.col("business_address")))))
        .alias("no_phone")))

register("zip_valid", f"""{O.norm_cte()}
SELECT entity_id, zip_pin, CASE WHEN zip_pin <> '' AND ({O.split_tokens('norm_address')}[1] IS NULL
  OR zip_pin <> {O.split_tokens('norm_address')}[1]) THEN zip_pin END AS zip_valid FROM norm""")(
    lambda spark, sf: norm(spark, sf).select(
        "entity_id", "zip_pin", tx.valid_zip(F.col("zip_pin"), F.col("norm_address")).alias("zip_valid")))


def _token_positions(spark, sf):
    n = norm(spark, sf)
    nt, at = tx.tokens(F.col("norm_name")), tx.tokens(F.col("norm_address"))
    g = lambda a, i: F.try_element_at(a, F.lit(i))
    return n.select("entity_id", g(nt, 1).alias("n0"), g(nt, 2).alias("n1"), g(nt, 3).alias("n2"),
                    g(nt, -1).alias("nlast"), g(nt, -2).alias("n2last"), F.size(nt).cast("long").alias("nlen"),
                    g(at, 1).alias("a0"), g(at, 2).alias("a1"), g(at, 3).alias("a2"), g(at, 4).alias("a3"),
                    g(at, -3).alias("ae3"), g(at, -2).alias("ae2"), F.size(at).cast("long").alias("alen"))


_NT, _AT = O.split_tokens("norm_name"), O.split_tokens("norm_address")
register("token_positions", f"""{O.norm_cte()}
SELECT entity_id, {_NT}[1] AS n0, {_NT}[2] AS n1, {_NT}[3] AS n2, {_NT}[-1] AS nlast, {_NT}[-2] AS n2last,
  CAST(len({_NT}) AS BIGINT) AS nlen, {_AT}[1] AS a0, {_AT}[2] AS a1, {_AT}[3] AS a2, {_AT}[4] AS a3,
  {_AT}[-3] AS ae3, {_AT}[-2] AS ae2, CAST(len({_AT}) AS BIGINT) AS alen FROM norm""")(_token_positions)

register("url_name_fold", """SELECT page_id, url,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '^\\s+|\\s+$', '', 'g')),
    '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '[/?#].*$', ''), ':\\d+$', ''), '\\.[a-z]{2,}$', '') AS name
FROM pages""")(
    lambda spark, sf: rs.table(spark, sf, "pages").select("page_id", "url", tx.url_name_fold(F.col("url")).alias("name")))

# ---------------------------------------------------------------------------
# Keys (B01–B15, A08)
# ---------------------------------------------------------------------------

for _v in ("v1", "v2", "v4"):
    register(f"keys_{_v}", f"""{O.norm_cte()},
{O.keys_cte(_v)}
SELECT entity_id, tag, key FROM keys""")(
        lambda spark, sf, _v=_v: explode_keys(norm(spark, sf), _v))

register("key_stats_v4", f"""{O.norm_cte()},
{O.keys_cte('v4')}
SELECT tag, count(DISTINCT key) AS unique_keys, count(*) AS entries, count(DISTINCT entity_id) AS records
FROM keys WHERE src <> 1 GROUP BY tag
UNION ALL
SELECT 'ALL', count(DISTINCT (tag, key)), count(*), count(DISTINCT entity_id) FROM keys WHERE src <> 1""")(
    lambda spark, sf: key_stats(explode_keys(split_norm(spark, sf)[1], "v4")))

# ---------------------------------------------------------------------------
# Blocking (J01–J03, L03, U02, S05) and evaluation
# ---------------------------------------------------------------------------

for _v in ("v1", "v2", "v4"):
    _cap = CAPS[_v]
    register(f"block_{_v}", f"{O.block_cte(_v, _cap)} SELECT * FROM blk")(
        lambda spark, sf, _v=_v: blocked(spark, sf, _v))
    register(f"blocking_recall_{_v}", f"""{O.block_cte(_v, _cap)},
per AS (
  SELECT t.s1_id, count(*) AS n_true, count(b.cand_id) AS n_found,
         (SELECT count(*) FROM blk b2 WHERE b2.s1_id = t.s1_id) AS n_cands
  FROM truth t LEFT JOIN blk b ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id GROUP BY t.s1_id),
agg AS (
  SELECT coalesce(sum(n_true), 0)::BIGINT AS total_true_matches, coalesce(sum(n_found), 0)::BIGINT AS found_in_candidates,
         count(*) FILTER (WHERE n_true > n_found) AS n_entities_with_miss,
         count(*) FILTER (WHERE n_true > n_found AND n_cands = 0) AS zero_cand_misses FROM per)
SELECT *, total_true_matches - found_in_candidates AS missed,
  CASE WHEN total_true_matches > 0 THEN round(found_in_candidates / total_true_matches, 6) ELSE 0.0 END AS blocking_recall,
  CASE WHEN (CASE WHEN total_true_matches > 0 THEN round(found_in_candidates / total_true_matches, 6) ELSE 0.0 END) < 0.90 THEN 'WARNING'
       WHEN (CASE WHEN total_true_matches > 0 THEN round(found_in_candidates / total_true_matches, 6) ELSE 0.0 END) < 0.95 THEN 'NOTE'
       ELSE 'OK' END AS status
FROM agg""")(lambda spark, sf, _v=_v: ev.blocking_recall(truth(spark, sf), blocked(spark, sf, _v, listed=True)))

_B4 = O.block_cte("v4", MAX_CANDIDATES_V4)

register("block_v4_cap20", f"{O.block_cte('v4', 20)} SELECT * FROM blk")(
    lambda spark, sf: blocked(spark, sf, "v4", cap=20))

register("candidate_lists_v4", f"""{_B4}
SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(b.cand_id, ',' ORDER BY b.cand_id), '') AS candidate_entity_ids
FROM s1 LEFT JOIN blk b ON s1.entity_id = b.s1_id GROUP BY s1.entity_id""")(
    lambda spark, sf: bl.candidate_lists(split_norm(spark, sf)[0], blocked(spark, sf, "v4", listed=True)))

register("zero_candidates_v4", f"""{_B4}
SELECT entity_id AS s1_id FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM blk)""")(
    lambda spark, sf: split_norm(spark, sf)[0].select(F.col("entity_id").alias("s1_id"))
    .join(blocked(spark, sf, "v4", listed=True), "s1_id", "left_anti"))


def _counts(spark, sf, version="v4", cap=None):
    cap = CAPS[version] if cap is None else cap
    s1, _ = split_norm(spark, sf)
    return ev.candidate_counts(s1, blocked(spark, sf, version, cap, with_overflow=True, listed=True), cap)


register("candidate_stats_v4", f"""{_B4}
SELECT count(*) AS n_entities, coalesce(sum(n), 0)::BIGINT AS total_pairs, coalesce(round(avg(n), 2), 0.0) AS avg_candidates,
  count(*) FILTER (WHERE n = 0) AS zero_candidates, count(*) FILTER (WHERE capped) AS capped_entities FROM counts""")(
    lambda spark, sf: ev.candidate_stats(_counts(spark, sf)))

register("candidate_stats_v4_cap20", f"""{O.block_cte('v4', 20)}
SELECT count(*) AS n_entities, coalesce(sum(n), 0)::BIGINT AS total_pairs, coalesce(round(avg(n), 2), 0.0) AS avg_candidates,
  count(*) FILTER (WHERE n = 0) AS zero_candidates, count(*) FILTER (WHERE capped) AS capped_entities FROM counts""")(
    lambda spark, sf: ev.candidate_stats(_counts(spark, sf, cap=20)))

register("candidate_hist_v4", f"""{_B4},
buckets(bucket_order, bucket, lo, hi) AS (VALUES (0, '0', 0, 0), (1, '1-10', 1, 10), (2, '11-50', 11, 50),
  (3, '51-100', 51, 100), (4, '101-200', 101, 200), (5, '201-300', 201, 300), (6, '300+', 301, 1000000000))
SELECT CAST(bucket_order AS INTEGER) AS bucket_order, bucket, count(c.s1_id) AS n_entities
FROM buckets LEFT JOIN counts c ON c.n BETWEEN lo AND hi GROUP BY bucket_order, bucket""")(
    lambda spark, sf: ev.candidate_hist(_counts(spark, sf)))

register("found_pairs_v4", f"{_B4} SELECT t.s1_id, t.cand_id FROM truth t SEMI JOIN blk b ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id")(
    lambda spark, sf: ev.found_pairs(truth(spark, sf), blocked(spark, sf, "v4", listed=True)))

register("missed_pairs_v4", f"{_B4} SELECT t.s1_id, t.cand_id FROM truth t ANTI JOIN blk b ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id")(
    lambda spark, sf: ev.missed_pairs(truth(spark, sf), blocked(spark, sf, "v4", listed=True)))

register("recall_miss_sample_v4", f"""{_B4},
per AS (
  SELECT t.s1_id, count(*) AS n_true, count(b.cand_id) AS n_found FROM truth t
  LEFT JOIN blk b ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id GROUP BY t.s1_id),
nc AS (SELECT s1_id, count(*) AS n_cands FROM blk GROUP BY s1_id),
first AS (SELECT per.*, coalesce(nc.n_cands, 0)::BIGINT AS n_cands FROM per LEFT JOIN nc USING (s1_id)
          WHERE n_true > n_found ORDER BY s1_id LIMIT 10),
miss AS (SELECT t.s1_id, t.cand_id, row_number() OVER (PARTITION BY t.s1_id ORDER BY t.cand_id) AS r
         FROM truth t ANTI JOIN blk b ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id)
SELECT f.s1_id, f.n_true, f.n_found, f.n_true - f.n_found AS n_missed, f.n_cands,
  (SELECT string_agg(cand_id, ',' ORDER BY cand_id) FROM miss m WHERE m.s1_id = f.s1_id AND r <= 3) AS missed
FROM first f""")(lambda spark, sf: ev.recall_miss_sample(truth(spark, sf), blocked(spark, sf, "v4", listed=True)))

register("reduction_ratio_v4", f"""{_B4}
SELECT (SELECT count(*) FROM counts) AS n_s1, (SELECT count(*) FROM records WHERE src <> 1) AS n_targets,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM counts) AS pairs,
  round(1 - (SELECT coalesce(sum(n), 0) FROM counts) / ((SELECT count(*) FROM counts) * (SELECT count(*) FROM records WHERE src <> 1)), 9) AS reduction_ratio""")(
    lambda spark, sf: ev.reduction_ratio(split_norm(spark, sf)[1], _counts(spark, sf)))


def _recall_by_key(spark, sf):
    s1, tg = split_norm(spark, sf)
    t = truth(spark, sf)
    shared = bl.shared_keys(t, explode_keys(s1, "v4"), explode_keys(tg, "v4"))
    return ev.recall_by_key(shared, t)


register("recall_by_key_v4", f"""{O.norm_cte()},
{O.keys_cte('v4')},
{O.truth_cte()},
sh AS (SELECT DISTINCT t.s1_id, t.cand_id, a.tag FROM truth t
       JOIN keys a ON a.entity_id = t.s1_id JOIN keys b ON b.entity_id = t.cand_id AND a.tag = b.tag AND a.key = b.key),
np AS (SELECT s1_id, cand_id, count(*) AS k FROM sh GROUP BY ALL)
SELECT sh.tag, count(*) AS pairs_sharing, count(*) FILTER (WHERE np.k = 1) AS only_this_key,
  round(count(*) / (SELECT count(*) FROM truth), 6) AS recall_alone
FROM sh JOIN np USING (s1_id, cand_id) GROUP BY sh.tag""")(_recall_by_key)

# ---------------------------------------------------------------------------
# Profiling
# ---------------------------------------------------------------------------

from matchbook.operators import profile as pf  # noqa: E402
from matchbook.operators import quality as dq  # noqa: E402

_TW = f"""{REC}, {O.truth_cte()},
tw AS (SELECT r.entity_id AS source1_entity_id, l.matched_entity_ids
       FROM records r LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS matched_entity_ids
                                 FROM truth GROUP BY s1_id) l ON r.entity_id = l.s1_id WHERE r.src = 1),
mc AS (SELECT source1_entity_id, CAST(CASE WHEN matched_entity_ids IS NULL OR matched_entity_ids = '' THEN 0
              ELSE len(string_split(matched_entity_ids, ',')) END AS BIGINT) AS match_count FROM tw)"""


def _rt(spark, sf):
    r = rs.records(spark, sf)
    return r, rs.truth_wide(r)


register("shapes", f"""{_TW}
SELECT 'S' || CAST(src AS VARCHAR) AS source, count(*) AS rows, 4 AS n_cols FROM records GROUP BY src
UNION ALL SELECT 'truth', count(*), 2 FROM tw""")(lambda spark, sf: pf.shapes(*_rt(spark, sf)))

register("null_rates", f"""{_TW},
r AS (SELECT 'S' || CAST(src AS VARCHAR) AS source, count(*) AS n,
        count(*) FILTER (WHERE entity_id IS NULL) AS entity_id, count(*) FILTER (WHERE business_name IS NULL) AS business_name,
        count(*) FILTER (WHERE business_address IS NULL) AS business_address, count(*) FILTER (WHERE country IS NULL) AS country
      FROM records GROUP BY src),
t AS (SELECT 'truth' AS source, count(*) AS n, count(*) FILTER (WHERE source1_entity_id IS NULL) AS source1_entity_id,
        count(*) FILTER (WHERE matched_entity_ids IS NULL) AS matched_entity_ids FROM tw)
SELECT source, 'entity_id' AS column_name, round(entity_id * 100.0 / n, 2) AS null_pct FROM r
UNION ALL SELECT source, 'business_name', round(business_name * 100.0 / n, 2) FROM r
UNION ALL SELECT source, 'business_address', round(business_address * 100.0 / n, 2) FROM r
UNION ALL SELECT source, 'country', round(country * 100.0 / n, 2) FROM r
UNION ALL SELECT source, 'source1_entity_id', round(source1_entity_id * 100.0 / n, 2) FROM t
UNION ALL SELECT source, 'matched_entity_ids', round(matched_entity_ids * 100.0 / n, 2) FROM t""")(
    lambda spark, sf: pf.null_rates(*_rt(spark, sf)))

register("country_top", f"""{REC},
c AS (SELECT 'S' || CAST(src AS VARCHAR) AS source, country AS value, count(*) AS n FROM records
      WHERE country IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10""")(
    lambda spark, sf: pf.top_values(rs.records(spark, sf)))

register("encoding_issues", f"""{REC},
a AS (SELECT 'S' || CAST(src AS VARCHAR) AS source, count(*) FILTER (WHERE contains(business_name, '???')) AS bn,
        count(*) FILTER (WHERE contains(business_address, '???')) AS ba FROM records GROUP BY src)
SELECT source, 'business_name' AS column_name, bn AS n_rows FROM a
UNION ALL SELECT source, 'business_address', ba FROM a""")(
    lambda spark, sf: pf.encoding_issues(rs.records(spark, sf)))

register("match_count_hist", f"{_TW} SELECT match_count, count(*) AS n_entities FROM mc GROUP BY match_count")(
    lambda spark, sf: pf.match_count_hist(_rt(spark, sf)[1]))

register("match_count_stats", f"""{_TW},
s AS (SELECT list_sort(list(match_count)) AS v, count(*) AS n FROM mc)
SELECT n AS total_s1_entities, (SELECT count(*) FROM mc WHERE match_count = 0) AS singletons_count,
  round((SELECT count(*) FROM mc WHERE match_count = 0) * 100.0 / n, 2) AS singletons_pct,
  round((SELECT avg(match_count) FROM mc), 3) AS mean_matches,
  (v[CAST(floor((n - 1) / 2) AS BIGINT) + 1] + v[CAST(floor(n / 2) AS BIGINT) + 1]) / 2.0 AS median_matches,
  (SELECT min(match_count) FROM mc) AS min_matches, (SELECT max(match_count) FROM mc) AS max_matches,
  CAST(v[CAST(floor(0.25 * (n - 1) + 0.5) AS BIGINT) + 1] AS DOUBLE) AS p25,
  CAST(v[CAST(floor(0.75 * (n - 1) + 0.5) AS BIGINT) + 1] AS DOUBLE) AS p75,
  CAST(v[CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1] AS DOUBLE) AS p95
FROM s""")(lambda spark, sf: pf.match_count_stats(_rt(spark, sf)[1]))

_ZIPRAW = "(^|[^\\p{L}\\p{N}_])[0-9]{5}(-[0-9]{4})?($|[^\\p{L}\\p{N}_])|(^|[^\\p{L}\\p{N}_])[0-9]{6}($|[^\\p{L}\\p{N}_])"
register("address_coverage", f"""{REC},
a AS (SELECT 'S' || CAST(src AS VARCHAR) AS source, count(*) AS total_records, count(business_address) AS records_with_address,
        count(*) FILTER (WHERE regexp_matches(business_address, '{_ZIPRAW}')) AS records_with_zip_or_pin
      FROM records GROUP BY src)
SELECT *, round((total_records - records_with_address) * 100.0 / total_records, 2) AS address_null_pct,
  CASE WHEN records_with_address > 0 THEN round(records_with_zip_or_pin * 100.0 / records_with_address, 2) ELSE 0.0 END AS zip_coverage_pct
FROM a""")(lambda spark, sf: pf.address_coverage(rs.records(spark, sf)))

register("normalize_stats", f"""{O.norm_cte()}
SELECT src, count(*) AS rows, count(*) FILTER (WHERE zip_pin <> '') AS zip_extracted,
  count(*) FILTER (WHERE business_address IS NULL) AS addr_null,
  round(count(*) FILTER (WHERE zip_pin <> '') * 100.0 / count(*), 2) AS zip_pct FROM norm GROUP BY src""")(
    lambda spark, sf: normalize_stats(norm(spark, sf)))

register("noisy_pair_sample", f"""{_TW},
first AS (SELECT * FROM tw WHERE matched_entity_ids IS NOT NULL AND matched_entity_ids <> ''
          ORDER BY source1_entity_id LIMIT 30),
ids AS (SELECT source1_entity_id AS s1_id, trim(x) AS match_id FROM first,
        unnest(string_split(matched_entity_ids, ',')[1:2]) AS u(x)),
ex AS (SELECT i.s1_id, s.business_name AS s1_name, s.business_address AS s1_addr, i.match_id,
         t.business_name AS match_name, t.business_address AS match_addr
       FROM ids i JOIN records s ON s.entity_id = i.s1_id AND s.src = 1
       JOIN records t ON t.entity_id = i.match_id AND t.src <> 1),
per AS (SELECT s1_id, count(*) AS k FROM ex GROUP BY s1_id),
keep AS (SELECT s1_id FROM (SELECT s1_id, coalesce(sum(k) OVER (ORDER BY s1_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per) WHERE before < 10)
SELECT ex.* FROM ex SEMI JOIN keep USING (s1_id)""")(lambda spark, sf: pf.noisy_pair_sample(*_rt(spark, sf)))

# ---------------------------------------------------------------------------
# Data-quality rules on our candidate file
# ---------------------------------------------------------------------------


def _cand_file(spark, sf):
    s1, _ = split_norm(spark, sf)
    return bl.candidate_lists(s1, blocked(spark, sf, "v4", listed=True)), s1.select("entity_id")


def _dq_offenders(spark, sf):
    lists, req = _cand_file(spark, sf)
    valid = split_norm(spark, sf)[1].select("entity_id")  # ids of the normalised records: the records are not joined again
    return dq.offenders(lists, "source1_entity_id", "candidate_entity_ids", req, valid)


_CF = f"""{_B4},
cf AS (SELECT s1.entity_id AS s1, coalesce(string_agg(b.cand_id, ',' ORDER BY b.cand_id), '') AS lst
       FROM s1 LEFT JOIN blk b ON s1.entity_id = b.s1_id GROUP BY s1.entity_id),
ids AS (SELECT DISTINCT s1, x AS id FROM cf, unnest(string_split(lst, ',')) AS u(x) WHERE trim(lst) <> ''),
valid AS (SELECT entity_id FROM records WHERE src <> 1),
offs AS (
  SELECT 'duplicate_s1' AS rule, s1 AS offender FROM cf GROUP BY s1 HAVING count(*) > 1
  UNION SELECT 'repeated_ids', s1 FROM cf WHERE trim(lst) <> '' AND len(string_split(lst, ',')) <> len(list_distinct(string_split(lst, ',')))
  UNION SELECT 'self_match', id FROM ids WHERE starts_with(id, 'S1-')
  UNION SELECT 'wrong_prefix', id FROM ids WHERE NOT starts_with(id, 'S1-') AND NOT (starts_with(id, 'S2-') OR starts_with(id, 'S3-'))
  UNION SELECT 'missing_s1', entity_id FROM s1 WHERE entity_id NOT IN (SELECT s1 FROM cf)
  UNION SELECT 'extra_s1', s1 FROM cf WHERE s1 NOT IN (SELECT entity_id FROM s1)
  UNION SELECT 'unknown_ids', id FROM ids WHERE (starts_with(id, 'S2-') OR starts_with(id, 'S3-')) AND id NOT IN (SELECT entity_id FROM valid))"""

register("dq_offenders_candidates", f"{_CF} SELECT rule, offender, 'error' AS severity FROM offs")(_dq_offenders)

register("dq_report_candidates", f"""{_CF}
SELECT 'candidate_pairs.tsv' AS file, rule, 'error' AS severity, count(*) AS n_offenders,
  array_to_string(list_sort(list(offender ORDER BY offender)[1:5]), ', ') AS examples
FROM offs GROUP BY rule""")(lambda spark, sf: dq.report(_dq_offenders(spark, sf), "candidate_pairs.tsv"))

register("dq_row_counts_candidates", f"""{_CF}
SELECT 'candidate_pairs.tsv' AS file, count(*) AS rows, count(*) FILTER (WHERE trim(lst) = '') AS empty,
  count(*) FILTER (WHERE trim(lst) <> '') AS non_empty FROM cf""")(
    lambda spark, sf: dq.row_counts(_cand_file(spark, sf)[0], "candidate_entity_ids", "candidate_pairs.tsv"))

register("dq_summary_candidates", f"""{_CF}
SELECT CAST(count(*) AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings,
  CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM offs""")(
    lambda spark, sf: dq.summary(dq.report(_dq_offenders(spark, sf), "candidate_pairs.tsv")))

# ---------------------------------------------------------------------------
# Matching stage: pair features, scores, thresholds, F0.5
# ---------------------------------------------------------------------------

from matchbook.operators import features as fe  # noqa: E402
from matchbook.operators import match as mt  # noqa: E402


def _blocks(spark, sf):
    return bl.profile_blocks(*split_norm(spark, sf), "v4", MAX_CANDIDATES_V4)


def _pf(spark, sf, features=None, truth_=None):
    """Candidate pairs (v4, capped) with all features, or those that are named, and with ``n_true`` of a given truth."""
    return fe.all_features(_blocks(spark, sf), norm(spark, sf), features, truth_)


def _scored(spark, sf, more=(), truth_=None):
    return fe.fixed_score(_pf(spark, sf, [*fe.SCORE_FEATURES, *more], truth_))


_PF = O.pair_features_cte()
_K = ["s1_id", "cand_id"]
register("pair_features_name", f"{_PF} SELECT s1_id, cand_id, {', '.join(fe.NAME_FEATURES)} FROM pf")(
    lambda spark, sf: _pf(spark, sf, fe.NAME_FEATURES).select(*_K, *fe.NAME_FEATURES))
register("pair_features_addr", f"{_PF} SELECT s1_id, cand_id, {', '.join(fe.ADDR_FEATURES)} FROM pf")(
    lambda spark, sf: _pf(spark, sf, fe.ADDR_FEATURES).select(*_K, *fe.ADDR_FEATURES))
register("pair_features_meta", f"{_PF} SELECT s1_id, cand_id, {', '.join(fe.META_FEATURES)} FROM pf")(
    lambda spark, sf: _pf(spark, sf, fe.META_FEATURES).select(*_K, *fe.META_FEATURES))
register("pair_jaro_winkler", f"{_PF} SELECT s1_id, cand_id, round(jaro_winkler_similarity(na, nb), 6) AS name_jaro_winkler FROM pf")(
    lambda spark, sf: _pf(spark, sf, ["name_jaro_winkler"]).select(*_K, "name_jaro_winkler"))


def _rare(spark, sf):
    return fe.rare_token_feature(_blocks(spark, sf), norm(spark, sf))


register("pair_rare_tokens", f"""{_PF},
dfa AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT entity_id, unnest({O._tset('norm_address')}) AS token FROM norm) GROUP BY token)
SELECT s1_id, cand_id, CAST((SELECT count(*) FROM unnest(list_intersect({O._tset('aa')}, {O._tset('ab')})) AS u(tok)
                             JOIN dfa ON dfa.token = u.tok WHERE dfa.df <= 5) AS BIGINT) AS shared_rare_tokens FROM pf""")(_rare)

register("pair_scores", f"{_PF} SELECT s1_id, cand_id, score FROM ps")(
    lambda spark, sf: _scored(spark, sf).select(*_K, "score"))

register("ensemble_score", f"""{_PF}
SELECT s1_id, cand_id, (score + round(jaro_winkler_similarity(na, nb), 6) + name_lev_ratio) / 3 AS ensemble FROM ps""")(
    lambda spark, sf: _scored(spark, sf, ["name_lev_ratio", "name_jaro_winkler"]).select(
        *_K, ((F.col("score") + F.col("name_jaro_winkler") + F.col("name_lev_ratio")) / 3).alias("ensemble")))

register("matches", f"{_PF} SELECT s1_id, cand_id, score FROM ps WHERE score > 0.5")(
    lambda spark, sf: mt.threshold_matches(_scored(spark, sf), 0.5))

register("matching_results", f"""{_PF}
SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(m.cand_id, ',' ORDER BY m.cand_id), '') AS matched_entity_ids
FROM s1 LEFT JOIN (SELECT * FROM ps WHERE score > 0.5) m ON s1.entity_id = m.s1_id GROUP BY s1.entity_id""")(
    lambda spark, sf: mt.match_lists(split_norm(spark, sf)[0], mt.threshold_matches(_scored(spark, sf), 0.5)))


def _f05_per(spark, sf):
    return mt.f05_per_entity(split_norm(spark, sf)[0], truth(spark, sf),
                             mt.threshold_matches(_scored(spark, sf), 0.5))


_F05 = f"""{_PF},
m AS (SELECT s1_id, cand_id FROM ps WHERE score > 0.5),
fo AS (SELECT coalesce(t.s1_id, m.s1_id) AS s1_id, t.cand_id AS tc, m.cand_id AS mc FROM truth t FULL JOIN m
       ON t.s1_id = m.s1_id AND t.cand_id = m.cand_id),
per0 AS (SELECT s1_id, count(tc) AS n_true, count(mc) AS n_pred, count(*) FILTER (WHERE tc IS NOT NULL AND mc IS NOT NULL) AS tp
         FROM fo GROUP BY s1_id),
per AS (SELECT s1.entity_id AS s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
        FROM s1 LEFT JOIN per0 ON s1.entity_id = per0.s1_id)"""
register("f05_per_entity", f"{_F05} SELECT *, round({O.f05_expr('tp', 'n_pred', 'n_true')}, 6) AS f05 FROM per")(_f05_per)
register("f05_macro", f"""{_F05} SELECT count(*) AS n_entities, round(avg(round({O.f05_expr('tp', 'n_pred', 'n_true')}, 6)), 6) AS f05_macro FROM per""")(
    lambda spark, sf: mt.f05_macro(_f05_per(spark, sf)))

_TUNE = f"""{_PF},
grid AS (SELECT CAST(j AS INTEGER) AS j, round(j * 0.05, 2) AS t FROM range(0, 21) AS g(j)),
nt AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY s1_id),
lab AS (SELECT ps.s1_id, ps.cand_id, ps.score, t.cand_id IS NOT NULL AS is_true FROM ps
        LEFT JOIN truth t ON t.s1_id = ps.s1_id AND t.cand_id = ps.cand_id),
pj AS (SELECT l.s1_id, g.j, count(*) AS n_pred, count(*) FILTER (WHERE is_true) AS tp FROM lab l JOIN grid g ON l.score > g.t
       GROUP BY l.s1_id, g.j),
full_ AS (SELECT s1.entity_id AS s1_id, g.j, coalesce(pj.n_pred, 0) AS n_pred, coalesce(pj.tp, 0) AS tp, coalesce(nt.n_true, 0) AS n_true
          FROM s1 CROSS JOIN grid g LEFT JOIN pj ON pj.s1_id = s1.entity_id AND pj.j = g.j LEFT JOIN nt ON nt.s1_id = s1.entity_id),
tuned AS (SELECT CAST(round(j * 0.05, 2) AS DOUBLE) AS threshold, round(avg({O.f05_expr('tp', 'n_pred', 'n_true')}), 6) AS f05_macro FROM full_ GROUP BY j)"""


def _tuned(spark, sf):
    t = truth(spark, sf)
    return mt.tune_threshold(split_norm(spark, sf)[0], t, _scored(spark, sf, truth_=t))


register("tune_threshold", f"{_TUNE} SELECT * FROM tuned")(_tuned)
register("best_threshold", f"""{_TUNE}
SELECT max(threshold) FILTER (WHERE f05_macro = (SELECT max(f05_macro) FROM tuned)) AS threshold, max(f05_macro) AS f05_macro FROM tuned""")(
    lambda spark, sf: mt.best_threshold(_tuned(spark, sf)))

register("training_pairs", f"""{_PF},
lab AS (SELECT b.s1_id, b.cand_id, CASE WHEN t.cand_id IS NULL THEN 0 ELSE 1 END AS label FROM blk b
        LEFT JOIN truth t ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id),
r AS (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY md5(s1_id || cand_id), cand_id) AS rn,
        sum(label) OVER (PARTITION BY s1_id) AS npos FROM lab)
SELECT s1_id, cand_id, CAST(label AS INTEGER) AS label FROM r
WHERE label = 1 OR rn <= CASE WHEN npos > 0 THEN npos * 10 ELSE 10 END""")(
    lambda spark, sf: mt.training_pairs(blocked(spark, sf, "v4", listed=True), truth(spark, sf)))

register("entity_split", f"""{REC}
SELECT entity_id AS s1_id, CAST(('0x' || substr(md5(entity_id), 1, 2))::INTEGER % 5 AS INTEGER) AS fold FROM records WHERE src = 1""")(
    lambda spark, sf: rs.source1(rs.records(spark, sf)).select(
        F.col("entity_id").alias("s1_id"), mt.entity_fold(F.col("entity_id")).cast("int").alias("fold")))


def _score_pairs(spark, sf):
    """GBT on folds 1–4 of the training pairs, probabilities for all candidate pairs (R)."""
    pf_ = written(_pf(spark, sf), "pair-features")
    t = truth(spark, sf)
    train = (mt.training_pairs(pf_.select(*_K), t)
             .where(mt.entity_fold(F.col("s1_id")) != 0)
             .join(pf_, _K))
    return mt.gbt_scores(written(train, "training"), pf_)  # a fit reads its rows several times


register("score_pairs")(_score_pairs)


def _f05_out_of_fold(spark, sf):
    """GBT and fixed score side by side, both with thresholds tuned on the other folds (R)."""
    s1, t = split_norm(spark, sf)[0], written(truth(spark, sf), "truth")
    pf_ = written(_pf(spark, sf, None, t), "pair-features")  # with n_true, so that no pair meets the truth again
    train = written(mt.training_pairs(pf_.select(*_K), t).join(pf_, _K), "training")  # each fit reads its rows several times
    gbt = mt.out_of_fold_scores(train, pf_, max_iter=10).withColumnRenamed("probability", "score")
    both = {"gbt_out_of_fold": written(gbt, "pair-scores"), "fixed_score": fe.fixed_score(pf_)}
    rows = [mt.f05_out_of_fold(s1, t, scored).select(F.lit(name).alias("method"), "*") for name, scored in both.items()]
    return rows[0].unionByName(rows[1])


register("f05_out_of_fold")(_f05_out_of_fold)

# ---------------------------------------------------------------------------
# Retrieval keys (M01, M02) and rerankers of the blocking pairs
# ---------------------------------------------------------------------------

from matchbook.operators import retrieve as rt  # noqa: E402

_NTT = O.split_tokens("norm_name")
register("keys_phonetic", f"""{O.norm_cte()},
first AS (SELECT entity_id, coalesce({O.strip_ws('lower(country)')}, '') AS cty, {_NTT}[1] AS t FROM norm)
SELECT entity_id, 'phon' AS tag, cty || '|' || ({O.soundex('t')}) AS key FROM first WHERE t IS NOT NULL""")(
    lambda spark, sf: rt.keys_phonetic(norm(spark, sf)))

register("keys_tfidf_top3", f"""{O.norm_cte()},
terms AS (SELECT entity_id, coalesce({O.strip_ws('lower(country)')}, '') AS cty, term, count(*) AS tf
          FROM (SELECT entity_id, country, unnest({_NTT}) AS term FROM norm) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
w AS (SELECT t.*, tf * (ln((1 + (SELECT count(*) FROM norm)) / (1 + df)) + 1) AS weight FROM terms t JOIN dfs USING (term)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, term) AS r FROM w) WHERE r <= 3)
SELECT entity_id, 'tfidf3' AS tag, cty || '|' || array_to_string(list_sort(list(term)), ' ') AS key FROM top GROUP BY entity_id, cty""")(
    lambda spark, sf: rt.keys_tfidf_top3(norm(spark, sf)))


def _bm25(spark, sf):
    return rt.rerank_bm25(_blocks(spark, sf), *split_norm(spark, sf))


register("bm25_rerank", f"""{_B4},
docs AS (SELECT entity_id, cty, term, dl, count(*) AS tf FROM (
           SELECT entity_id, coalesce({O.strip_ws('lower(country)')}, '') AS cty, len({_NTT}) AS dl, unnest({_NTT}) AS term
           FROM norm WHERE src <> 1) GROUP BY ALL),
stats AS (SELECT cty, count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT DISTINCT entity_id, cty, dl FROM docs) GROUP BY cty),
idf AS (SELECT d.cty, d.term, ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) AS idf, s.avgdl
        FROM (SELECT cty, term, count(*) AS df FROM docs GROUP BY ALL) d JOIN stats s USING (cty)),
qt AS (SELECT DISTINCT entity_id AS s1_id, unnest({_NTT}) AS term FROM norm WHERE src = 1),
sc AS (SELECT b.s1_id, b.cand_id, round(sum(i.idf * d.tf * 2.2 / (d.tf + 1.2 * (1 - 0.75 + 0.75 * d.dl / i.avgdl))), 6) AS bm25
       FROM blk b JOIN qt ON qt.s1_id = b.s1_id JOIN docs d ON d.entity_id = b.cand_id AND d.term = qt.term
       JOIN idf i ON i.cty = d.cty AND i.term = d.term GROUP BY b.s1_id, b.cand_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY bm25 DESC, cand_id) AS rank FROM sc) WHERE rank <= 10""")(_bm25)


def _pair_tfidf(spark, sf, best=None):
    n = norm(spark, sf)
    return rt.pair_tfidf_cosine(_blocks(spark, sf), rt.name_gram_weights(n), n, best)


_GRAMS = " || ".join(
    f"CASE WHEN length(coalesce(norm_name, '')) >= {n} THEN list_transform(range(1, length(norm_name) - {n - 2}), "
    f"lambda i: substr(norm_name, i, {n})) ELSE []::VARCHAR[] END" for n in (2, 3, 4))
_TFIDF = f"""{_B4},
tf AS (SELECT entity_id, gram, count(*) AS tf FROM (SELECT entity_id, unnest({_GRAMS}) AS gram FROM norm) GROUP BY ALL),
dfg AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
w0 AS (SELECT entity_id, gram, tf * (ln((1 + (SELECT count(*) FROM norm)) / (1 + df)) + 1) AS w FROM tf JOIN dfg USING (gram)),
w AS (SELECT entity_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM w0),
cos AS (SELECT b.s1_id, b.cand_id, round(coalesce(sum(x.w * y.w), 0.0), 6) AS tfidf_cosine
        FROM blk b LEFT JOIN w x ON x.entity_id = b.s1_id LEFT JOIN w y ON y.entity_id = b.cand_id AND y.gram = x.gram
        GROUP BY b.s1_id, b.cand_id)"""
register("pair_tfidf", f"{_TFIDF} SELECT * FROM cos")(lambda spark, sf: _pair_tfidf(spark, sf))
register("tfidf_rerank", f"""{_TFIDF}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY tfidf_cosine DESC, cand_id) AS rank FROM cos) WHERE rank <= 10""")(
    lambda spark, sf: rt.rerank_tfidf(_pair_tfidf(spark, sf, 10)))

from matchbook.plans import catalog_files, catalog_retrieval, catalog_scripts  # noqa: E402,F401
