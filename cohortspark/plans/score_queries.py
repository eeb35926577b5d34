"""Queries over scores and labels: splits, ROC, cuts, rules, comparisons, models."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import roc
from ..operators.attribution import attribute, importance, linear_attribution, mean_with_error, model_info
from ..operators.compare import cohort_summary, compare_methods, method_averages, winners
from ..operators.confusion import binary_metrics, class_rates, cut_probability, precision_recall
from ..operators.grouped_fits import fit_logistic_groups, optimality
from ..operators.models import Baseline, fit_logistic, fit_model
from ..operators.selection import FeatureSelector, rank_agreement
from ..operators.split import Splitter, class_distribution, folds, split_stats, train_test
from ..operators.thresholds import (
    AttributionLiteratureRule,
    AttributionYoudenRule,
    LiteratureRule,
    QuantileFlags,
    Rule,
    YoudenRule,
    apply_rules,
)
from ..session import local_table, shared_folder, stage
from ..sources.sinks import load_splits, save_splits
from . import bindings as b
from .experiment import (
    cross_validate,
    evaluate_model,
    evaluate_rule,
    evaluate_rules,
    run_experiment,
)
from .grouped_experiments import run_cohort_table
from .panel_queries import METRICS_SQL, confusion_sql, metrics_select
from .registry import query, r

# --- splits ------------------------------------------------------------------

TRAIN, VAL = 1.0 - 0.2 - 0.1, 0.1
_CUT1, _CUT2 = f"floor(n * {TRAIN!r} + 1e-9)", f"floor(n * {TRAIN + VAL!r} + 1e-9)"
_SPLIT = f"CASE WHEN rn <= {_CUT1} THEN 'train' WHEN rn <= {_CUT2} THEN 'val' ELSE 'test' END"


def _ranked(table: str, order: str, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    return (
        f"ranked AS (SELECT *, row_number() OVER ({p} ORDER BY {order}) AS rn,"
        f" count(*) OVER ({p}) AS n FROM {table})"
    )


@query(
    "split_random",
    f"WITH {_ranked('customer', 'md5(\'42-\' || c_custkey)')} SELECT c_custkey, {_SPLIT} AS split FROM ranked",
)
def split_random(spark, sf):
    return Splitter().random(b.table(spark, sf, "customer"), ["c_custkey"]).select("c_custkey", "split")


@query(
    "split_temporal",
    f"WITH {_ranked('orders', 'o_orderdate, md5(\'0-\' || o_orderkey)')} SELECT o_orderkey, {_SPLIT} AS split FROM ranked",
)
def split_temporal(spark, sf):
    orders = b.table(spark, sf, "orders")
    return Splitter().temporal(orders, "o_orderdate", ["o_orderkey"]).select("o_orderkey", "split")


_STRAT = _ranked("orders", "md5('7-' || o_orderkey)", "o_orderpriority")


@query("split_stratified", f"WITH {_STRAT} SELECT o_orderkey, {_SPLIT} AS split FROM ranked")
def split_stratified(spark, sf):
    orders = b.table(spark, sf, "orders")
    return Splitter().stratified(orders, "o_orderpriority", ["o_orderkey"], 7).select("o_orderkey", "split")


@query(
    "split_statistics",
    f"WITH {_ranked('orders', 'o_orderdate, md5(\'0-\' || o_orderkey)')},"
    f" s AS (SELECT *, {_SPLIT} AS split, CAST(o_orderstatus = 'F' AS INT) AS label FROM ranked),"
    " g AS (SELECT split, label, count(*) AS class_n FROM s GROUP BY ALL),"
    " t AS (SELECT split, min(o_orderdate) AS t_start, max(o_orderdate) AS t_end, count(*) AS n FROM s GROUP BY split)"
    " SELECT 'temporal' AS strategy, g.split, t.n,"
    f" {r('t.n / (SELECT count(*) FROM orders)', 'proportion')}, CAST(label AS VARCHAR) AS class, class_n,"
    f" {r('round(100.0 * class_n / t.n, 2)', 'class_pct')}, t_start, t_end FROM g JOIN t ON g.split = t.split",
)
def split_statistics(spark, sf):
    orders = b.table(spark, sf, "orders").withColumn("label", F.expr("CAST(o_orderstatus = 'F' AS INT)"))
    marked = Splitter().temporal(orders, "o_orderdate", ["o_orderkey"])
    return split_stats(marked, "temporal", "label", "o_orderdate")


@query(
    "train_test_split",
    f"WITH {_ranked('orders', 'md5(\'42-\' || o_orderkey)', 'o_orderstatus')} SELECT o_orderkey FROM ranked"
    f" WHERE rn <= floor(n * {1.0 - 0.3!r} + 1e-9)",
)
def train_test_query(spark, sf):
    train, _ = train_test(b.table(spark, sf, "orders"), ["o_orderkey"], 0.3, "o_orderstatus")
    return train.select("o_orderkey")


def _fold(k: int) -> str:
    return " + ".join(f"CAST(rn > floor(n * {j} / {k} + 1e-9) AS INT)" for j in range(1, k))


_SCORES = (
    "scores AS (SELECT o_orderkey, o_orderpriority AS grp, o_totalprice AS score,"
    " CAST(o_orderstatus = 'F' AS INT) AS label FROM orders)"
)


@query(
    "kfold_assign",
    f"WITH {_SCORES}, {_ranked('scores', 'md5(\'42-\' || o_orderkey)', 'label')}"
    f" SELECT o_orderkey, label, {_fold(5)} AS fold FROM ranked",
)
def kfold_assign(spark, sf):
    return folds(b.order_scores(spark, sf), 5, ["o_orderkey"]).select("o_orderkey", "label", "fold")


@query(
    "class_distribution",
    "SELECT o_orderpriority AS class, count(*) AS n, "
    + r("round(100.0 * count(*) / (SELECT count(*) FROM orders), 2)", "pct")
    + " FROM orders GROUP BY o_orderpriority",
)
def class_distribution_query(spark, sf):
    return class_distribution(b.table(spark, sf, "orders"), "o_orderpriority")


@query(
    "split_round_trip",
    f"WITH {_STRAT}, s AS (SELECT *, {_SPLIT} AS split FROM ranked)"
    " SELECT split, count(*) AS n, " + r("avg(o_totalprice)", "mean_price") + " FROM s GROUP BY split",
)
def split_round_trip(spark, sf):
    marked = Splitter().stratified(b.table(spark, sf, "orders"), "o_orderpriority", ["o_orderkey"], 7)
    folder = f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    save_splits(marked, split_stats(marked, "stratified", "o_orderpriority"), "orders", folder)
    train, val, test, _ = load_splits(spark, "orders", folder)
    parts = [
        df.groupBy(F.lit(name).alias("split")).agg(
            F.expr("count(1) AS n"), F.expr("avg(o_totalprice) AS mean_price")
        )
        for name, df in (("train", train), ("val", val), ("test", test))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- ROC, areas, cuts --------------------------------------------------------


def roc_sql(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return (
        f"g AS (SELECT {head}score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg"
        f" FROM {source} GROUP BY {head}score),"
        f" c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,"
        f" CAST(sum(pos) OVER ({part}) AS BIGINT) AS p_total, CAST(sum(neg) OVER ({part}) AS BIGINT) AS n_total"
        f" FROM g WINDOW w AS ({part} ORDER BY score DESC)),"
        " roc AS (SELECT *, tp / nullif(p_total, 0) AS tpr, fp / nullif(n_total, 0) AS fpr FROM c)"
    )


_AUC = "sum(neg * (tp - pos + pos / 2)) / nullif(CAST(max(p_total) AS DOUBLE) * max(n_total), 0)"
_DOCS = (
    "docs AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS score, quality AS label"
    " FROM documents JOIN labels USING (doc_id))"
)


@query(
    "roc_table",
    f"WITH {_SCORES}, {roc_sql('scores', 'grp')} SELECT grp, {r('score', 'threshold')}, pos, neg, tp, fp, p_total, n_total,"
    f" {r('tpr', 'tpr')}, {r('fpr', 'fpr')} FROM roc",
)
def roc_table_query(spark, sf):
    return roc.roc_table(b.order_scores(spark, sf), by=["grp"])


@query("auc", f"WITH {_DOCS}, {roc_sql('docs')} SELECT {r(_AUC, 'auc')} FROM roc")
def auc_query(spark, sf):
    return roc.auc(b.document_scores(spark, sf))


@query(
    "auc_by_group",
    f"WITH {_SCORES}, {roc_sql('scores', 'grp')} SELECT grp, {r(_AUC, 'auc')} FROM roc GROUP BY grp",
)
def auc_by_group(spark, sf):
    return roc.auc(b.order_scores(spark, sf), by=["grp"])


_DIMS = (
    "dims AS (SELECT unnest(range(64)) AS d, unnest(embedding) AS v, label AS cls FROM embeddings),"
    " dimension AS (SELECT CAST(d AS INT) AS dim, CAST(v AS DOUBLE) AS score, CAST(cls < 5 AS INT) AS label FROM dims)"
)


@query(
    "feature_auc",
    f"WITH {_DIMS}, {roc_sql('dimension', 'dim')} SELECT dim, {r(_AUC, 'auc')} FROM roc GROUP BY dim",
)
def feature_auc(spark, sf):
    """The AUC of every feature on its own, all in one job."""
    return roc.auc(b.embedding_scores(spark, sf), by=["dim"])


@query(
    "pr_table",
    f"WITH {_SCORES}, {roc_sql('scores')} SELECT {r('score', 'threshold')}, {r('tp / (tp + fp)', 'precision')},"
    f" {r('tpr', 'recall')}, {r('p_total / (p_total + n_total)', 'baseline')}, pos, tp, fp, p_total FROM roc",
)
def pr_table_query(spark, sf):
    return roc.pr_table(b.order_scores(spark, sf))


@query(
    "pr_area",
    f"WITH {_SCORES}, {roc_sql('scores', 'grp')}, pr AS (SELECT grp, p_total, n_total, tpr, tp / (tp + fp) AS prec,"
    " lag(tp / (tp + fp)) OVER w AS prec0, lag(tpr) OVER w AS tpr0 FROM roc WINDOW w AS (PARTITION BY grp ORDER BY score DESC))"
    f" SELECT grp, {r('sum((tpr - coalesce(tpr0, 0)) * (prec + coalesce(prec0, 1)) / 2)', 'pr_auc')},"
    f" {r('max(p_total) / (max(p_total) + max(n_total))', 'baseline')} FROM pr GROUP BY grp",
)
def pr_area_query(spark, sf):
    return roc.pr_area(b.order_scores(spark, sf), by=["grp"])


def _best(by: str) -> str:
    return (
        f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY tpr - fpr DESC, score DESC) AS k FROM roc) WHERE k = 1)"
    )


@query(
    "youden_cut",
    f"WITH {_DIMS}, {roc_sql('dimension', 'dim')}, {_best('dim')} SELECT dim, {r('score', 'threshold')},"
    f" {r('tpr - fpr', 'youden_index')}, {r('tpr', 'sensitivity')}, {r('1 - fpr', 'specificity')} FROM best",
)
def youden_cut_query(spark, sf):
    return roc.youden_cut(b.embedding_scores(spark, sf), by=["dim"])


@query(
    "optimal_threshold",
    f"WITH {_SCORES}, {roc_sql('scores', 'grp')}, {_best('grp')} SELECT grp,"
    f" {r('CASE WHEN tpr - fpr > 0 THEN score END', 'threshold')}, {r('greatest(tpr - fpr, 0)', 'youden_index')},"
    f" {r('CASE WHEN tpr - fpr > 0 THEN tpr ELSE 0 END', 'sensitivity')},"
    f" {r('CASE WHEN tpr - fpr > 0 THEN 1 - fpr ELSE 1 END', 'specificity')} FROM best",
)
def optimal_threshold_query(spark, sf):
    return roc.optimal_threshold(b.order_scores(spark, sf), by=["grp"])


@query(
    "youden_cv",
    f"WITH {_SCORES}, {_ranked('scores', 'md5(\'42-\' || o_orderkey)', 'label')},"
    f" placed AS (SELECT score, label, {_fold(5)} AS fold FROM ranked), {roc_sql('placed', 'fold')}, {_best('fold')}"
    f" SELECT {r('avg(score)', 'threshold')}, {r('avg(tpr - fpr)', 'youden_index')}, {r('stddev_pop(score)', 'threshold_std')},"
    f" count(*) AS n_folds, {r('max(score)', 'highest')}, {r('min(score)', 'lowest')} FROM best",
)
def youden_cv_query(spark, sf):
    placed = folds(b.order_scores(spark, sf), 5, ["o_orderkey"])
    return roc.youden_cv(placed, "score").selectExpr(
        "threshold", "youden_index", "threshold_std", "n_folds",
        "array_max(cv_thresholds) AS highest", "array_min(cv_thresholds) AS lowest",
    )


# --- rules and metrics -------------------------------------------------------


RULES = [
    Rule("o_totalprice", 250_000.0, "high", "high_price"),
    Rule("o_totalprice", 180_000.0, "low", "low_price"),
]
_RULED = (
    "ruled AS (SELECT o_orderkey, c_mktsegment AS cohort, CAST(o_orderstatus = 'F' AS INT) AS label,"
    " CAST(o_totalprice >= 250000 AS INT) AS high_price, CAST(o_totalprice <= 180000 AS INT) AS low_price"
    " FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def _labelled_orders(spark, sf) -> DataFrame:
    people = b.table(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment AS cohort")
    return b.table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey", "cohort", "o_totalprice", "CAST(o_orderstatus = 'F' AS INT) AS label"
    )


@query(
    "rule_apply",
    f"WITH {_RULED} SELECT o_orderkey, high_price, low_price FROM ruled",
)
def rule_apply(spark, sf):
    return apply_rules(_labelled_orders(spark, sf), RULES).select("o_orderkey", "high_price", "low_price")


@query(
    "confusion_metrics",
    f"WITH {_RULED}, c AS ({confusion_sql('ruled', 'high_price', 'cohort')}), x AS (SELECT *,"
    " (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS ba,"
    " (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) AS m FROM c)"
    f" SELECT {metrics_select('cohort')}, {r('ba', 'balanced_accuracy')}, {r('m', 'mcc')} FROM x",
)
def confusion_metrics(spark, sf):
    scored = RULES[0].transform(_labelled_orders(spark, sf))
    return binary_metrics(scored, by=["cohort"], extended=True)


@query(
    "probability_cut",
    f"WITH s AS (SELECT CAST(o_orderstatus = 'F' AS INT) AS label, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS p FROM orders),"
    f" q AS (SELECT label, CAST(p >= 0.5 AS INT) AS prediction FROM s), c AS ({confusion_sql('q')})"
    f" SELECT {r('coalesce(' + METRICS_SQL['precision'] + ', 0)', 'precision')}, {r('coalesce(' + METRICS_SQL['recall'] + ', 0)', 'recall')} FROM c",
)
def probability_cut(spark, sf):
    orders = b.table(spark, sf, "orders")
    top = orders.selectExpr("max(o_totalprice)").first()[0]
    scored = orders.selectExpr("CAST(o_orderstatus = 'F' AS INT) AS label", f"o_totalprice / {top!r}D AS p")
    return precision_recall(scored, "p", threshold=0.5)


@query(
    "cut_predictions",
    "SELECT o_orderkey, CAST(l >= 0.04 AS INT) AS prediction FROM (SELECT l_orderkey AS o_orderkey, max(l_discount) AS l FROM lineitem GROUP BY 1)",
)
def cut_predictions(spark, sf):
    best = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_discount").alias("p")
    )
    return cut_probability(best, "p", 0.04).select("o_orderkey", "prediction")


@query(
    "class_rates",
    f"WITH {_RULED} SELECT cohort, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,"
    f" count(*) FILTER (WHERE label = 0) AS negatives, {r('avg(label)', 'positive_rate')}, CAST(avg(label) < 0.01 AS INT) AS low_rate"
    " FROM ruled GROUP BY cohort",
)
def class_rates_query(spark, sf):
    return class_rates(_labelled_orders(spark, sf), by=["cohort"])


def _metric_rows(spark, sf) -> DataFrame:
    return compare_methods(evaluate_rules(RULES, _labelled_orders(spark, sf), by=["cohort"]))


_METHODS = (
    f"WITH {_RULED}, c AS (SELECT 'high_price' AS method, * FROM ({confusion_sql('ruled', 'high_price', 'cohort')})"
    f" UNION ALL SELECT 'low_price', * FROM ({confusion_sql('ruled', 'low_price', 'cohort')})),"
    f" m AS (SELECT method, {metrics_select('cohort', rounding=False)} FROM c)"
)


@query("method_compare", f"{_METHODS} SELECT method, {metrics_select('cohort')} FROM c")
def method_compare(spark, sf):
    return _metric_rows(spark, sf)


_LONG = " UNION ALL ".join(
    f"SELECT cohort, method, '{s}' AS metric, {s} AS value FROM m"
    for s in ("auc", "f1", "precision", "recall", "sensitivity", "specificity", "accuracy")
)


@query(
    "method_winners",
    f"{_METHODS}, long AS ({_LONG}), w AS (SELECT cohort, metric, max(value) FILTER (WHERE method = 'high_price') AS a,"
    " max(value) FILTER (WHERE method = 'low_price') AS b FROM long GROUP BY cohort, metric)"
    f" SELECT cohort, metric, {r('a', 'first_value')}, {r('b', 'second_value')},"
    " CASE WHEN a > b THEN 'high_price' WHEN b > a THEN 'low_price' ELSE 'tie' END AS winner FROM w",
)
def method_winners(spark, sf):
    return winners(_metric_rows(spark, sf), "high_price", "low_price", ["cohort"])


@query(
    "cohort_summary",
    f"{_METHODS} SELECT cohort, "
    + ", ".join(
        r(f"max({s}) FILTER (WHERE method = '{m}')", f"{m}_{s}")
        for m in ("high_price", "low_price")
        for s in ("auc", "f1", "sensitivity", "specificity")
    )
    + " FROM m GROUP BY cohort",
)
def cohort_summary_query(spark, sf):
    return cohort_summary(_metric_rows(spark, sf), ["high_price", "low_price"])


@query(
    "method_averages",
    f"{_METHODS}, v AS (SELECT method, count(*) AS cohorts, avg(auc) AS auc, avg(f1) AS f1, avg(sensitivity) AS sensitivity,"
    f" avg(specificity) AS specificity FROM m GROUP BY method) SELECT method, cohorts, {r('auc', 'auc')}, {r('f1', 'f1')},"
    f" {r('sensitivity', 'sensitivity')}, {r('specificity', 'specificity')}, auc = max(auc) OVER () AS winner FROM v",
)
def method_averages_query(spark, sf):
    return method_averages(_metric_rows(spark, sf))


@query(
    "optimal_flags",
    f"WITH {_DIMS}, {roc_sql('dimension', 'dim')}, {_best('dim')}, f AS (SELECT vec_id, "
    + ", ".join(f"embedding[{i + 1}] AS e{i}" for i in range(b.DIMENSIONS))
    + " FROM embeddings) SELECT vec_id, "
    + ", ".join(
        f"CAST(e{i} >= (SELECT score FROM best WHERE dim = {i}) AS INT) AS e{i}_high" for i in range(b.DIMENSIONS)
    )
    + " FROM f",
)
def optimal_flags(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    return QuantileFlags(method="optimal").fit(frame, names).transform(frame, ["vec_id"])


# --- attribution and ranking -------------------------------------------------


_WEIGHTS = {f"e{i}": (i % 7 - 3.5) / 10 for i in range(b.DIMENSIONS)}
_PHI = (
    "x AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding) AS v FROM embeddings),"
    " xm AS (SELECT vec_id, d, CAST(v AS DOUBLE) AS value, avg(CAST(v AS DOUBLE)) OVER (PARTITION BY d) AS mu FROM x),"
    " phi AS (SELECT vec_id, 'e' || d AS feature, value, ((d % 7) - 3.5) / 10 * (value - mu) AS phi FROM xm)"
)


@query(
    "linear_attribution",
    f"WITH {_PHI} SELECT vec_id, feature, {r('value', 'value')}, {r('phi', 'phi')} FROM phi",
)
def linear_attribution_query(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    return linear_attribution(frame, names, _WEIGHTS, ["vec_id"])


@query(
    "attribution_importance",
    f"WITH {_PHI} SELECT feature, {r('avg(abs(phi))', 'mean_abs')}, {r('avg(phi)', 'mean_phi')},"
    f" {r('corr(value, phi)', 'corr')}, count(*) AS n FROM phi GROUP BY feature",
)
def attribution_importance(spark, sf):
    return importance(linear_attribution_query(spark, sf))


@query(
    "top_features",
    f"WITH {_PHI} SELECT feature, {r('avg(abs(phi))', 'mean_abs')} FROM phi GROUP BY feature ORDER BY avg(abs(phi)) DESC, feature LIMIT 10",
)
def top_features_query(spark, sf):
    return (
        attribution_importance(spark, sf)
        .orderBy(F.col("mean_abs").desc(), "feature")
        .limit(10)
        .select("feature", "mean_abs")
    )


@query(
    "rank_agreement",
    "WITH x AS (SELECT c_custkey AS k, round(any_value(c_acctbal), 0) AS a, count(*) AS b FROM customer JOIN orders ON o_custkey = c_custkey"
    " GROUP BY c_custkey),"
    " ra AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r1,"
    " rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS r2 FROM x),"
    " p AS (SELECT sum(sign(u.a - v.a) * sign(CAST(u.b - v.b AS DOUBLE))) AS s, count(*) FILTER (WHERE u.a <> v.a) AS na,"
    " count(*) FILTER (WHERE u.b <> v.b) AS nb FROM x u JOIN x v ON u.k < v.k)"
    f" SELECT (SELECT count(*) FROM x) AS n, {r('(SELECT corr(r1, r2) FROM ra)', 'spearman')},"
    f" {r('s / sqrt(CAST(na AS DOUBLE) * nb)', 'kendall')} FROM p",
)
def rank_agreement_query(spark, sf):
    orders = b.table(spark, sf, "orders").groupBy("o_custkey").agg(F.expr("count(1) AS b"))
    people = b.table(spark, sf, "customer").selectExpr("c_custkey", "round(c_acctbal, 0) AS a")
    return rank_agreement(people.join(orders, F.col("c_custkey") == F.col("o_custkey")), "a", "b")


def _weights_table(spark, pairs) -> DataFrame:
    return local_table(spark, [(f, float(v)) for f, v in pairs], "feature string, score double")


# Fits and sampled values have no SQL twin; their tests check invariants instead.


@query("logit_rule_literature")
def logit_rule_literature(spark, sf):
    frame, names = b.user_frame(spark, sf)
    frame = stage(frame)
    limits = {**b.ranges(), **b.CONFIG.thresholds["errors"]}
    return evaluate_rule(LiteratureRule(limits).fit(frame, names), frame)


@query("logit_rule_youden")
def logit_rule_youden(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    return evaluate_rule(YoudenRule(["vec_id"]).fit(frame, names), frame)


@query("attribution_rule_literature")
def attribution_rule_literature(spark, sf):
    frame, names = b.user_frame(spark, sf)
    frame = stage(frame)
    finder = AttributionLiteratureRule(b.ranges(), keys=["user_id"], settings={"trees": 100, "depth": 10})
    return evaluate_rule(finder.fit(frame, names), frame)


@query("attribution_rule_youden")
def attribution_rule_youden(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    finder = AttributionYoudenRule(keys=["vec_id"], settings={"trees": 100, "depth": 10})
    return evaluate_rule(finder.fit(frame, names), frame)


@query("tree_attribution_forest")
def tree_attribution_forest(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    model = fit_model(frame, names, kind="random_forest", settings={"trees": 100, "depth": 10})
    cores = spark.sparkContext.defaultParallelism
    return importance(attribute(model, frame, ["vec_id"], partitions=cores))


@query("tree_attribution_boosted")
def tree_attribution_boosted(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    model = fit_model(frame, names, kind="boosted_trees", settings={"trees": 100, "depth": 6})
    cores = spark.sparkContext.defaultParallelism
    return importance(attribute(model, frame, ["vec_id"], partitions=cores))


@query("sampled_attribution")
def sampled_attribution_query(spark, sf):
    frame, names = b.user_frame(spark, sf)
    frame = stage(frame)
    model = fit_model(frame, names, kind="logistic_regression")
    return importance(attribute(model, frame, ["user_id"], "sampled"))


@query("feature_ranking_lasso")
def feature_ranking_lasso(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    return _weights_table(spark, FeatureSelector("lasso").fit(stage(frame), names).ranking())


@query("feature_ranking_rfe")
def feature_ranking_rfe(spark, sf):
    frame, names = b.user_frame(spark, sf)
    return _weights_table(spark, FeatureSelector("rfe", k=1).fit(stage(frame), names).ranking())


@query("model_probabilities")
def model_probabilities(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    return Baseline("logistic_regression").fit(frame, names).predict_proba(frame).select(
        "vec_id", "label", "probability"
    )


@query("model_metrics")
def model_metrics(spark, sf):
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    return evaluate_model(fit_model(frame, names, kind="logistic_regression"), frame)


@query("rule_cross_validation")
def rule_cross_validation(spark, sf):
    frame, names = b.user_frame(spark, sf)
    return cross_validate(lambda: YoudenRule(), stage(frame), names, ["user_id"], 5)


@query("rule_experiment")
def rule_experiment(spark, sf):
    """Split, both coefficient rules, metrics on the test part."""
    frame, names = b.user_frame(spark, sf)
    return run_experiment(
        stage(frame), names, "errors", b.ranges(), ["user_id"], n_folds=5
    ).metrics


def _cohort_table(spark, sf) -> tuple[DataFrame, list[str]]:
    """One row per vector and class definition."""
    names = [f"e{i}" for i in range(b.DIMENSIONS)]
    return b.table(spark, sf, "embeddings").selectExpr(
        "vec_id", *[f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(b.DIMENSIONS)],
        "inline(array(struct('below_3' AS cohort, CAST(label < 3 AS INT) AS label),"
        " struct('below_6' AS cohort, CAST(label < 6 AS INT) AS label)))",
    ), names


def _cohort_runs(spark, sf):
    frame, names = _cohort_table(spark, sf)
    limits = {n: {"low": 0.0, "high": 0.0} for n in names}
    return run_cohort_table(frame, names, lambda _: limits, keys=["vec_id"])


@query("cohort_experiments")
def cohort_experiments(spark, sf):
    """The experiment for several class definitions in shared jobs, summarised side by side."""
    return cohort_summary(_cohort_runs(spark, sf).metrics, ["logistic_literature", "logistic_youden"])


# --- what fits and attributions must satisfy ---------------------------------


def _gaps(phi, outputs, base: float, key: str):
    """Per row: base value plus all attributions minus the model's output."""
    sums = phi.groupBy(key).agg(F.sum("phi").alias("__sum"))
    return sums.join(outputs, key).selectExpr(key, f"{base!r}D + __sum - __out AS gap")


@query("tree_attribution_adds_up", "SELECT vec_id, CAST(0 AS DOUBLE) AS gap FROM embeddings")
def tree_attribution_adds_up(spark, sf):
    """Base value and attributions of a forest add up to its probability, row by row."""
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    model = fit_model(frame, names, kind="random_forest", settings={"trees": 100, "depth": 10})
    phi = attribute(model, frame, ["vec_id"], partitions=spark.sparkContext.defaultParallelism)
    outputs = model.predict(frame, ["vec_id"]).selectExpr("vec_id", "probability AS __out")
    return _gaps(phi, outputs, model_info(model, frame)["base_value"], "vec_id")


@query("linear_attribution_adds_up", "SELECT vec_id, CAST(0 AS DOUBLE) AS gap FROM embeddings")
def linear_attribution_adds_up(spark, sf):
    """Base value and attributions of a logistic model add up to its log-odds."""
    frame, names = b.embedding_frame(spark, sf)
    frame = stage(frame)
    model = fit_model(frame, names, kind="logistic_regression")
    outputs = model.predict(frame, ["vec_id"]).selectExpr("vec_id", "ln(probability / (1 - probability)) AS __out")
    return _gaps(attribute(model, frame, ["vec_id"]), outputs, model_info(model, frame)["base_value"], "vec_id")


@query(
    "sampled_attribution_error",
    "SELECT DISTINCT event_type AS feature, (SELECT count(DISTINCT user_id) FROM events) AS n, true AS within"
    " FROM events WHERE event_type <> 'error'",
)
def sampled_attribution_error(spark, sf):
    """Mean sampled attributions of a logistic model lie within three standard errors of the closed form."""
    frame, names = b.user_frame(spark, sf)
    frame = stage(frame)
    model = fit_model(frame, names, kind="logistic_regression")
    sampled = mean_with_error(attribute(model, frame, ["user_id"], "sampled", output="log_odds"))
    exact = importance(attribute(model, frame, ["user_id"])).selectExpr("feature", "mean_phi AS exact")
    return sampled.join(exact, "feature").selectExpr("feature", "n", "abs(mean_phi - exact) <= 3 * se + 1e-9 AS within")


@query(
    "experiment_part_sizes",
    "WITH c AS (SELECT 'below_3' AS cohort, label < 3 AS l, count(*) AS c FROM embeddings GROUP BY ALL UNION ALL"
    " SELECT 'below_6', label < 6, count(*) FROM embeddings GROUP BY ALL)"
    " SELECT cohort, CAST(sum(floor(c * 0.7 + 1e-9)) AS BIGINT) AS train, CAST(sum(c - floor(c * 0.7 + 1e-9)) AS BIGINT) AS test"
    " FROM c GROUP BY cohort",
)
def experiment_part_sizes(spark, sf):
    """How many rows the experiment of each cohort learned from and was scored on."""
    run = _cohort_runs(spark, sf)
    learned = run.parts.where("split = 'train'").groupBy("cohort").agg(F.expr("count(1) AS train"))
    scored = run.metrics.where("method = 'logistic_youden'").selectExpr("cohort", "CAST(tp + fp + tn + fn AS BIGINT) AS test")
    return learned.join(scored, "cohort")


# A fit is optimal if no gradient is off its penalty by more than this share of the mean feature size.
OFF_OPTIMUM = 1e-5
_FITS = [
    ("literature", ["click", "purchase", "signup", "view"]), ("lasso", [f"e{i}" for i in range(b.DIMENSIONS)]),
    ("baseline", [f"e{i}" for i in range(b.DIMENSIONS)]),
    *[(f"fold {i}", ["click", "purchase", "signup", "view"]) for i in range(5)],
]


@query(
    "logit_fit_certificates",
    " UNION ALL ".join(
        f"SELECT '{fit}' AS fit, unnest({['', *names]!r}) AS feature, true AS optimal" for fit, names in _FITS
    ),
)
def logit_fit_certificates(spark, sf):
    """Optimality of the fits behind the rule, lasso, model and cross-validation queries, feature by feature."""
    users, names = b.user_frame(spark, sf)
    users = stage(folds(users, 5, ["user_id"]))
    vectors, dims = b.embedding_frame(spark, sf)
    vectors = stage(vectors)
    rule = LiteratureRule(b.ranges()).fit(users, names)
    models = [("literature", users, names, rule.metadata["weights"], rule.metadata["intercept"], False)]
    for name, l1 in (("lasso", True), ("baseline", False)):
        model = fit_logistic(vectors, dims, c=1.0, l1=l1)
        models.append((name, vectors, dims, model.weights, model.intercept, l1))
    for fit in fit_logistic_groups(users, names, leave_out="fold")[0]:
        kept = users.where(F.col("fold") != fit.left_out)
        models.append((f"fold {fit.left_out}", kept, names, fit.weights, fit.intercept, False))
    rows = [
        optimality(df, features, weights, intercept, l1=l1).selectExpr(f"'{name}' AS fit", "feature", f"violation < {OFF_OPTIMUM!r}D AS optimal")
        for name, df, features, weights, intercept, l1 in models
    ]
    return functools.reduce(DataFrame.unionByName, rows)
