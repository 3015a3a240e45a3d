"""Matching stage (specified in the reference's documents): threshold the
pair scores, score with macro F0.5 per S1, tune the threshold, build
training pairs and entity folds, train a gradient-boosted classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.operators.blocking import lists_by_s1
from matchbook.session import written

GRID = [round(i * 0.05, 2) for i in range(21)]
BETA2 = 0.25  # F0.5


def f_beta(tp, n_pred, n_true):
    """Per-entity F0.5; empty truth scores 1 iff the prediction is empty too."""
    p = F.when(n_pred > 0, tp / n_pred).otherwise(F.lit(0.0))
    r = F.when(n_true > 0, tp / n_true).otherwise(F.lit(0.0))
    f = F.when(BETA2 * p + r > 0, (1 + BETA2) * p * r / (BETA2 * p + r)).otherwise(F.lit(0.0))
    return F.when(n_true == 0, F.when(n_pred == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(f)


def f05_per_entity(s1: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Per S1 (all of them): n_true, n_pred, tp, f05."""
    t = truth.select("s1_id", "cand_id", F.lit(1).alias("t"))
    p = pred.select("s1_id", "cand_id", F.lit(1).alias("p"))
    both = t.join(p, ["s1_id", "cand_id"], "full_outer")
    per = both.groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"),
                                    F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"))
    out = (s1.select(F.col("entity_id").alias("s1_id")).join(per, "s1_id", "left")
           .select("s1_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_true", "n_pred", "tp")]))
    return out.withColumn("f05", F.round(f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6))


def f05_macro(per: DataFrame) -> DataFrame:
    return per.agg(F.count(F.lit(1)).alias("n_entities"), F.round(F.avg("f05"), 6).alias("f05_macro"))


def threshold_matches(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Pairs with ``score > threshold``, one for all or a column."""
    return scored.where(F.col("score") > threshold).select("s1_id", "cand_id", "score")


def grid_points_below(score: Column) -> Column:
    """How many grid points a score is above: a guess that is one off at most, set right by the points beside it."""
    grid, n = F.array(*[F.lit(g) for g in GRID]), F.lit(len(GRID))
    k = F.least(F.greatest(F.ceil(score * (len(GRID) - 1)), F.lit(0)), n).cast("int")
    right = k + F.when(score > F.get(grid, k), 1).otherwise(0) - F.when(score <= F.get(grid, k - 1), 1).otherwise(0)
    return F.coalesce(F.when(F.isnan(score), n).otherwise(right), F.lit(0))


def grid_counts(truth: DataFrame, scored: DataFrame) -> DataFrame:
    """``(s1_id, m, np, ntp)``: pairs and true pairs whose score is above ``m`` grid points, at most 22 rows an S1 record.

    Pairs that bring ``n_true``, how often the truth has them, are counted where they are made, without a join of all pairs.
    """
    if "n_true" in scored.columns:
        lab, pairs, true = scored, F.sum(F.greatest("n_true", F.lit(1))), F.sum("n_true")
    else:
        lab = scored.select("s1_id", "cand_id", "score").join(
            truth.select("s1_id", "cand_id", F.lit(1).alias("is_true")), ["s1_id", "cand_id"], "left")
        pairs, true = F.count(F.lit(1)), F.count("is_true")
    return lab.groupBy("s1_id", grid_points_below(F.col("score")).alias("m")).agg(pairs.alias("np"), true.alias("ntp"))


def tune_threshold(s1: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """Macro F0.5 for every grid threshold.

    Each pair contributes to thresholds below its score; pairs, unless they
    come as ``grid_counts``, are first reduced to ``(s1, m)`` counts where
    m = grid points below the score, so the work is |pairs| + 21·|S1| rows,
    never 21·|pairs|.
    """
    per_m = scored if "ntp" in scored.columns else grid_counts(truth, scored)
    # a score of 0 or null is above no threshold; sequence(0, -1) would run backwards
    per_j = (per_m.where(F.col("m") > 0).select("s1_id", "np", "ntp", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
             .groupBy("s1_id", "j").agg(F.sum("np").alias("n_pred"), F.sum("ntp").alias("tp")))
    n_true = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    base = (s1.select(F.col("entity_id").alias("s1_id"))
            .select("s1_id", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("j")))
    full = (base.join(per_j, ["s1_id", "j"], "left").join(n_true, "s1_id", "left")
            .select("s1_id", "j", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "tp", "n_true")]))
    per_t = (full.withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))
             .groupBy("j").agg(F.round(F.avg("f"), 6).alias("f05_macro")))
    return per_t.select(F.round(F.col("j") * 0.05, 2).alias("threshold"), "f05_macro")


def best_threshold(tuned: DataFrame) -> DataFrame:
    """Argmax of macro F0.5; ties go to the larger threshold (21 rows)."""
    return tuned.agg(F.max_by("threshold", F.struct("f05_macro", "threshold")).alias("threshold"),
                     F.max("f05_macro").alias("f05_macro"))


def match_lists(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """``matching_results`` file: one row per S1 incl. empty lists."""
    agg = matches.groupBy("s1_id").agg(
        F.array_join(F.sort_array(F.collect_list("cand_id")), ",").alias("matched_entity_ids"))
    return (s1.select(F.col("entity_id").alias("s1_id")).join(agg, "s1_id", "left")
            .select(F.col("s1_id").alias("source1_entity_id"),
                    F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids")))


def training_pairs(pairs: DataFrame, truth: DataFrame, neg_ratio: int = 10) -> DataFrame:
    """Positives = candidate pairs in truth; negatives = other candidates in
    ``md5(s1||cand)`` order, at most ``neg_ratio`` × positives of that S1
    (``neg_ratio`` when it has none) (M22).

    Pairs, or their lists, meet the truth as one list per S1; the at most ``cap`` candidates are ordered there."""
    truths = truth.groupBy("s1_id").agg(F.collect_list("cand_id").alias("true_ids"))
    met = (lists_by_s1(pairs).join(truths, "s1_id", "left")
           .withColumn("true_ids", F.coalesce("true_ids", F.array().cast("array<string>"))))
    found = F.filter("true_ids", lambda t: F.array_contains("cand_ids", t))
    order = lambda c: F.struct(F.md5(F.concat("s1_id", c)).alias("h"), c.alias("c"))
    other = F.filter("cand_ids", lambda c: ~F.array_contains("true_ids", c))
    lab = met.select("s1_id", F.flatten(F.transform(found, lambda t: F.filter("cand_ids", lambda c: c == t))).alias("pos"),
                     F.array_sort(F.transform(other, order))["c"].alias("neg"))
    quota = F.when(F.size("pos") > 0, F.size("pos") * neg_ratio).otherwise(F.lit(neg_ratio))
    of = lambda label: lambda c: F.struct(c.alias("cand_id"), F.lit(label).alias("label"))
    rows = F.concat(F.transform("pos", of(1)), F.transform(F.slice("neg", F.lit(1), quota), of(0)))
    return lab.select("s1_id", F.explode(rows).alias("x")).select("s1_id", "x.cand_id", "x.label")


def entity_fold(s1_id_col, k: int = 5):
    """Fold = first two hex digits of md5(s1_id) mod k."""
    return F.pmod(F.conv(F.substring(F.md5(s1_id_col), 1, 2), 16, 10).cast("int"), F.lit(k))


FEATURE_COLS = ["name_char3_jaccard", "name_token_jaccard", "name_lev_ratio", "token_sort_ratio",
                "prefix_tokens", "addr_token_jaccard", "addr_lev_ratio", "country_match",
                "name_len_ratio", "both_address", "zip_match", "street_no_match", "name_phonetic_match"]


def gbt_scores(train: DataFrame, score_on: DataFrame, seed: int = 7, max_iter: int = 20) -> DataFrame:
    """Train a GBT classifier on labelled pair features, score ``score_on``.

    Nulls (missing address parts) become -1 so the trees can split on them. Pairs keep their ``n_true``.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def prep(df):
        return df.fillna(-1.0, subset=[c for c in FEATURE_COLS])

    asm = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=max_iter,
                          maxDepth=4, seed=seed).fit(asm.transform(prep(train)))
    out = model.transform(asm.transform(prep(score_on)))
    return out.select("s1_id", "cand_id", *[c for c in ("n_true",) if c in out.columns],
                      F.round(vector_to_array("probability")[1], 6).alias("probability"))


def out_of_fold_scores(train: DataFrame, pairs: DataFrame, k: int = 5, **options) -> DataFrame:
    """Every pair scored by the model that saw no pair of its S1 record: ``k`` models, one a fold of entities."""
    out = None
    for f in range(k):
        own = entity_fold(F.col("s1_id"), k) == f
        part = gbt_scores(train.where(~own), pairs.where(own), **options)
        out = part if out is None else out.unionByName(part)
    return out


def f05_out_of_fold(s1: DataFrame, truth: DataFrame, scored: DataFrame, k: int = 5) -> DataFrame:
    """Macro F0.5 over all S1 where the threshold of each fold is tuned on the other folds.

    The pairs are read twice whatever ``k``: to count them by score and to take the matches."""
    counts = written(grid_counts(truth, scored), "grid-counts")
    limits = []
    for f in range(k):
        others = lambda c: entity_fold(F.col(c), k) != f  # noqa: B023, E731
        tuned = tune_threshold(s1.where(others("entity_id")), truth.where(others("s1_id")), counts.where(others("s1_id")))
        best = best_threshold(tuned).head().threshold
        limits.append(F.lit(1.0 if best is None else best))
    matches = threshold_matches(scored, F.get(F.array(*limits), entity_fold(F.col("s1_id"), k)))
    return f05_macro(f05_per_entity(s1, truth, matches))
