"""Confusion counts, ranking metrics, threshold grids and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.operators import metrics as M
from echotrail.operators.ranges import ranking_from_counts, ranking_metrics
from echotrail.operators.skew import join_keys
from echotrail.plans import inputs as I
from echotrail.plans.registry import query

P = f"WITH p AS ({I.PREDICTIONS_SQL})"
KEYS = ["task_name", "feature_set"]


def rounded(df, digits=6):
    """Round every double column, so both engines agree on the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


CONF = """count(*) FILTER (y_true = 0 AND pred = 0) AS tn, count(*) FILTER (y_true = 0 AND pred = 1) AS fp,
          count(*) FILTER (y_true = 1 AND pred = 0) AS fn, count(*) FILTER (y_true = 1 AND pred = 1) AS tp"""
RATES = """CASE WHEN tp + tn + fp + fn > 0 THEN round((tp + tn) / (tp + tn + fp + fn), 6) END AS accuracy,
  round(coalesce((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END) / 2,
     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END), 6) AS balanced_accuracy,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE CAST(0 AS DOUBLE) END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE CAST(0 AS DOUBLE) END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE CAST(0 AS DOUBLE) END AS f1,
  CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 6) END AS specificity,
  CASE WHEN tn + fp > 0 THEN round(fp / (tn + fp), 6) END AS false_positive_rate,
  CASE WHEN tp + fn > 0 THEN round(fn / (tp + fn), 6) END AS false_negative_rate"""


def grid_sql(start, stop, step, keys="task_name, feature_set"):
    return f"""{P}, th AS (SELECT k AS threshold_pct, k / CAST(100 AS DOUBLE) AS threshold FROM range({start}, {stop + 1}, {step}) r(k)),
s AS (SELECT p.*, th.*, CASE WHEN prob >= threshold THEN 1 ELSE 0 END AS pred FROM p, th),
g0 AS (SELECT {keys}, threshold, threshold_pct, {CONF} FROM s GROUP BY ALL)"""


STEPS = """, d AS (SELECT {keys}, {score} AS score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
   FROM {src} GROUP BY ALL),
steps AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
   sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS q
   FROM d WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
AUC = "CASE WHEN max(p) > 0 AND max(q) > 0 THEN round(sum(neg * (tp - pos + pos / 2)) / (max(p) * CAST(max(q) AS DOUBLE)), 6) END"
AP = "CASE WHEN max(p) > 0 AND max(q) > 0 THEN round(sum(pos * (tp / (tp + fp))) / max(p), 6) END"


@query("a17_confusion_counts", f"""{P} SELECT task_name, feature_set, {CONF}
FROM (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM p) GROUP BY ALL""")
def confusion(spark, sf):
    df = I.predictions(spark, sf).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    return df.groupBy(*KEYS).agg(*M.confusion_counts(F.col("y_true"), F.col("pred")))


@query("a18_metric_rows", f"""{P}, s AS (SELECT CASE WHEN feature_set = 'ssl' THEN task_name ELSE 'acoustic' END AS scope, y_true,
   CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM p),
c AS (SELECT scope, count(*) AS n, {CONF} FROM s GROUP BY scope)
SELECT v.scope, coalesce(n, 0) AS n, tn, fp, fn, tp,
  round((tp + tn) / n, 6) AS accuracy,
  CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) END AS balanced_accuracy,
  CASE WHEN n IS NULL THEN NULL WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE CAST(0 AS DOUBLE) END AS precision,
  CASE WHEN n IS NULL THEN NULL WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE CAST(0 AS DOUBLE) END AS recall,
  CASE WHEN n IS NOT NULL THEN round(tn / greatest(tn + fp, 1), 6) END AS specificity,
  CASE WHEN n IS NOT NULL THEN round(fp / greatest(tn + fp, 1), 6) END AS fpr,
  CASE WHEN n IS NOT NULL THEN round(fn / greatest(tp + fn, 1), 6) END AS fnr,
  CASE WHEN n IS NULL THEN NULL WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE CAST(0 AS DOUBLE) END AS f1
FROM (VALUES ('origin_file_model'), ('replay_file_model'), ('mixer_file_model'), ('acoustic'), ('empty_scope')) v(scope)
LEFT JOIN c ON c.scope = v.scope""")
def metric_rows(spark, sf):
    df = I.predictions(spark, sf).select(
        F.when(F.col("feature_set") == "ssl", F.col("task_name")).otherwise("acoustic").alias("scope"),
        "y_true", (F.col("prob") >= 0.5).cast("int").alias("pred"))
    return rounded(M.metric_rows(df, "scope", "y_true", "pred", [
        "origin_file_model", "replay_file_model", "mixer_file_model", "acoustic", "empty_scope"]))


@query("a19_classification_metrics", f"""{P}{STEPS.format(keys='task_name, feature_set', score='prob', src='p')},
r AS (SELECT task_name, feature_set, {AUC} AS roc_auc, {AP} AS average_precision FROM steps GROUP BY ALL),
c AS (SELECT task_name, feature_set, {CONF}, round(avg((prob - y_true) * (prob - y_true)), 6) AS brier_score
   FROM (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM p) GROUP BY ALL)
SELECT c.task_name, c.feature_set, tn, fp, fn, tp, {RATES}, brier_score, roc_auc, average_precision
FROM c JOIN r USING (task_name, feature_set)""")
def classification(spark, sf):
    x, pos, neg = F.col("prob"), F.col("pos"), F.col("neg")
    flag = x >= 0.5
    total = lambda c, name: F.sum(c).alias(name)
    ranking = ranking_metrics(I.predictions(spark, sf), KEYS, "prob", "y_true", [
        total(F.when(flag, 0).otherwise(neg), "tn"), total(F.when(flag, neg).otherwise(0), "fp"),
        total(F.when(flag, 0).otherwise(pos), "fn"), total(F.when(flag, pos).otherwise(0), "tp"),
        (F.sum(pos * (x - 1) * (x - 1) + neg * x * x) / F.sum(pos + neg)).alias("brier_score")])
    return rounded(M.with_rates(ranking.drop("eer")))


@query("a20_roc_auc", f"""{P}, r AS (SELECT task_name, feature_set, y_true,
   rank() OVER (PARTITION BY task_name, feature_set ORDER BY prob)
     + (count(*) OVER (PARTITION BY task_name, feature_set, prob) - 1) / 2 AS mid_rank FROM p)
SELECT task_name, feature_set, round((sum(mid_rank) FILTER (y_true = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS roc_auc
FROM (SELECT *, count(*) FILTER (y_true = 1) OVER (PARTITION BY task_name, feature_set) AS n1,
   count(*) FILTER (y_true = 0) OVER (PARTITION BY task_name, feature_set) AS n0 FROM r)
GROUP BY task_name, feature_set, n1, n0""")
def roc_auc(spark, sf):
    return rounded(ranking_metrics(I.predictions(spark, sf), KEYS, "prob", "y_true").select(*KEYS, "roc_auc"))


@query("a21_average_precision", f"""{P}{STEPS.format(keys='task_name, feature_set', score='prob', src='p')}
SELECT task_name, feature_set, {AP} AS average_precision FROM steps GROUP BY ALL""")
def average_precision(spark, sf):
    return rounded(ranking_metrics(I.predictions(spark, sf), KEYS, "prob", "y_true").select(*KEYS, "average_precision"))


EER_TAIL = """, n AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn
   FROM steps WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
pts AS (SELECT {keys}, fp, tp, fp / q AS fpr, 1 - tp / p AS fnr FROM n
   WHERE p > 0 AND q > 0 AND NOT (rn > 1 AND np IS NOT NULL AND np = pos AND nn = neg)
   UNION ALL SELECT DISTINCT {keys}, 0, 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM n WHERE p > 0 AND q > 0),
best AS (SELECT {keys}, round((fnr + fpr) / 2, 6) AS eer FROM pts
   QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY abs(fnr - fpr), fp, tp) = 1)"""


@query("a22_equal_error_rate", f"""{P}{STEPS.format(keys='task_name, feature_set', score='prob', src='p')}
{EER_TAIL.format(keys='task_name, feature_set')}
SELECT k.task_name, k.feature_set, eer FROM (SELECT DISTINCT task_name, feature_set FROM p) k LEFT JOIN best USING (task_name, feature_set)""")
def equal_error_rate(spark, sf):
    return rounded(ranking_metrics(I.predictions(spark, sf), KEYS, "prob", "y_true").select(*KEYS, "eer"))


SCOPED = """, x AS (SELECT 'overall' AS scope, 'all' AS value, prob, y_true FROM p
  UNION ALL SELECT 'task', task_name, prob, y_true FROM p UNION ALL SELECT 'feature_set', feature_set, prob, y_true FROM p
  UNION ALL SELECT 'is_replay', CASE WHEN task_name = 'replay_file_model' THEN 'true' ELSE 'false' END, prob, y_true FROM p)"""


@query("a23_evaluation_by_group", f"""{P}{SCOPED}{STEPS.format(keys='scope, value', score='prob', src='x')}
{EER_TAIL.format(keys='scope, value')},
r AS (SELECT scope, value, CAST(max(p) + max(q) AS BIGINT) AS samples, {AUC} AS auc FROM steps GROUP BY ALL),
a AS (SELECT scope, value, round(100 * avg(CASE WHEN (prob >= 0.5) = (y_true = 1) THEN 1 ELSE 0 END), 4) AS accuracy_pct FROM x GROUP BY ALL)
SELECT r.scope, r.value, samples, round(100 * eer, 4) AS eer_pct, auc, accuracy_pct
FROM r JOIN a USING (scope, value) LEFT JOIN best USING (scope, value)""")
def evaluation_by_group(spark, sf):
    keys = ["scope", "value"]
    dist = I.predictions(spark, sf).groupBy("task_name", "feature_set", "prob").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    pair = lambda s, v: F.struct(F.lit(s).alias("scope"), v.alias("value"))
    scopes = F.array(
        pair("overall", F.lit("all")), pair("task", F.col("task_name")),
        pair("feature_set", F.col("feature_set")),
        pair("is_replay", F.when(F.col("task_name") == "replay_file_model", "true").otherwise("false")))
    spread = dist.select(F.explode(scopes).alias("s"), "prob", "pos", "neg").select("s.*", "prob", "pos", "neg")
    right = F.when(F.col("prob") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    out = ranking_from_counts(spread, keys, "prob", [F.sum(F.col("pos") + F.col("neg")).alias("samples"), F.sum(right).alias("_right")])
    return out.select(*keys, "samples", F.round(100 * F.round("eer", 6), 4).alias("eer_pct"),
                      F.round("roc_auc", 6).alias("auc"),
                      F.round(100 * F.col("_right") / F.col("samples"), 4).alias("accuracy_pct"))


@query("a24_multiclass_report", """WITH s AS (SELECT l_returnflag AS y_true, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS y_pred FROM lineitem),
c AS (SELECT y_true, y_pred, count(*) AS n FROM s GROUP BY ALL),
k AS (SELECT DISTINCT unnest([y_true, y_pred]) AS class FROM c)
SELECT class, CAST(coalesce(sum(n) FILTER (y_true = class AND y_pred = class), 0) AS BIGINT) AS hits,
  CAST(coalesce(sum(n) FILTER (y_true = class), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (y_pred = class), 0) AS BIGINT) AS predicted,
  round(hits / greatest(predicted, 1), 6) AS precision, round(hits / greatest(support, 1), 6) AS recall,
  round(2 * hits / greatest(support + predicted, 1), 6) AS f1
FROM k, c GROUP BY class""")
def multiclass(spark, sf):
    q = F.col("l_quantity")
    s = I.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("y_true"),
        F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("y_pred"))
    c = s.groupBy("y_true", "y_pred").count()
    # each confusion cell counts towards the row total of one class and the column total of another
    side = lambda cls, hit, sup, pred: F.struct(
        cls.alias("class"), hit.alias("h"), sup.alias("s"), pred.alias("p"))
    zero, n = F.lit(0).cast("long"), F.col("count")
    same = F.col("y_true") == F.col("y_pred")
    parts = c.select(F.explode(F.array(
        side(F.col("y_true"), F.when(same, n).otherwise(zero), n, zero),
        side(F.col("y_pred"), zero, zero, n))).alias("x")).select("x.*")
    t = parts.groupBy("class").agg(F.sum("h").alias("hits"), F.sum("s").alias("support"),
                                   F.sum("p").alias("predicted"))
    h, one = F.col("hits"), F.lit(1)
    return t.select("*", F.round(h / F.greatest("predicted", one), 6).alias("precision"),
                    F.round(h / F.greatest("support", one), 6).alias("recall"),
                    F.round(2 * h / F.greatest(F.col("support") + F.col("predicted"), one), 6).alias("f1"))


def grid(spark, sf, start, stop, step, keys=KEYS):
    return M.threshold_counts(I.predictions(spark, sf), keys, "prob", "y_true", start, stop, step)


@query("a25_threshold_grid", f"""{grid_sql(5, 95, 5)} SELECT task_name, feature_set, threshold, tn, fp, fn, tp, {RATES} FROM g0""")
def threshold_grid(spark, sf):
    return rounded(M.with_rates(grid(spark, sf, 5, 95, 5)).drop("threshold_pct"))


@query("a26_threshold_sweep", f"""{grid_sql(50, 90, 10, "'overall' AS scope")}
SELECT threshold, round(100 * (tp + tn) / (tp + tn + fp + fn), 4) AS accuracy_pct,
  round(100 * fp / (fp + tn), 4) AS negative_fpr_pct FROM g0""")
def threshold_sweep(spark, sf):
    df = I.predictions(spark, sf).withColumn("scope", F.lit("overall"))
    g = M.threshold_counts(df, ["scope"], "prob", "y_true", 50, 90, 10)
    tn, fp, fn, tp = (F.col(c) for c in M.COUNTS)
    return g.select("threshold", F.round(100 * (tp + tn) / (tp + tn + fp + fn), 4).alias("accuracy_pct"),
                    F.round(100 * fp / (fp + tn), 4).alias("negative_fpr_pct"))


@query("a27_threshold_recommendation", f"""{grid_sql(5, 95, 5)}, g AS (SELECT *, {RATES} FROM g0),
b AS (SELECT * FROM g WHERE false_positive_rate <= 0.05
   QUALIFY row_number() OVER (PARTITION BY task_name, feature_set ORDER BY balanced_accuracy DESC, f1 DESC, threshold_pct) = 1)
SELECT k.task_name, k.feature_set, b.threshold AS recommended_threshold, b.false_positive_rate AS fpr_at_threshold,
  b.recall AS recall_at_threshold, b.balanced_accuracy AS balanced_accuracy_at_threshold, b.f1 AS f1_at_threshold,
  CASE WHEN b.threshold IS NULL THEN 'manual_review_only' ELSE 'candidate_for_review' END AS recommended_use
FROM (SELECT DISTINCT task_name, feature_set FROM g) k LEFT JOIN b USING (task_name, feature_set)""")
def threshold_recommendation(spark, sf):
    g = rounded(M.with_rates(grid(spark, sf, 5, 95, 5)))
    return M.recommend_threshold(g, KEYS, 0.05)


@query("a28_threshold_by_specificity", f"""{grid_sql(5, 95, 1)}, g AS (SELECT *, {RATES} FROM g0)
SELECT task_name, feature_set, threshold, recall, specificity, balanced_accuracy, f1 FROM g
QUALIFY row_number() OVER (PARTITION BY task_name, feature_set ORDER BY (specificity >= 0.9) DESC, recall DESC, specificity DESC,
   balanced_accuracy DESC, f1 DESC, threshold_pct DESC) = 1""")
def threshold_by_specificity(spark, sf):
    g = rounded(M.with_rates(grid(spark, sf, 5, 95, 1)))
    return M.choose_by_specificity(g, KEYS, 0.9).select(
        *KEYS, "threshold", "recall", "specificity", "balanced_accuracy", "f1")


@query("a29_axis_threshold_rates", f"""{P}, s AS (
   SELECT task_name AS axis, 'recommended' AS at_threshold, y_true, CASE WHEN prob >= 0.62 THEN 1 ELSE 0 END AS pred FROM p
   UNION ALL SELECT task_name, 'release', y_true, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END FROM p)
SELECT axis, at_threshold, count(*) AS n, {CONF}, round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(tn / greatest(tn + fp, 1), 6) AS specificity FROM s GROUP BY axis, at_threshold""")
def axis_threshold_rates(spark, sf):
    p, y = F.col("prob"), F.col("y_true")
    wide = I.predictions(spark, sf).groupBy(F.col("task_name").alias("axis")).agg(
        *[F.struct(F.count(F.lit(1)).alias("n"), *M.confusion_counts(y, (p >= t).cast("int"))).alias(name)
          for name, t in (("recommended", 0.62), ("release", 0.5))])
    long = wide.select("axis", F.explode(F.array(*[
        F.struct(F.lit(n).alias("at_threshold"), F.col(n).alias("c")) for n in ("recommended", "release")])).alias("r"))
    one = F.lit(1)
    return long.select("axis", "r.at_threshold", "r.c.*").select(
        "*", F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one), 6).alias("recall"),
        F.round(F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), one), 6).alias("specificity"))


@query("a30_recall_at_max_fpr", f"""{grid_sql(1, 99, 1)}
SELECT task_name, feature_set, round(max(CASE WHEN tn + fp > 0 AND fp / (tn + fp) <= 0.1 THEN CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END END), 6) AS recall_at_max_fpr
FROM g0 GROUP BY ALL""")
def recall_at_max_fpr(spark, sf):
    return rounded(M.recall_at_max_fpr(grid(spark, sf, 1, 99, 1), KEYS, 0.1))


ECE = """, bn AS (SELECT task_name, feature_set, (prob >= 0.1::DOUBLE)::INT + (prob >= 0.2::DOUBLE)::INT + (prob >= 3 * 0.1::DOUBLE)::INT
   + (prob >= 0.4::DOUBLE)::INT + (prob >= 0.5::DOUBLE)::INT + (prob >= 6 * 0.1::DOUBLE)::INT + (prob >= 7 * 0.1::DOUBLE)::INT
   + (prob >= 0.8::DOUBLE)::INT + (prob >= 0.9::DOUBLE)::INT AS b, prob, y_true FROM p),
be AS (SELECT task_name, feature_set, b, count(*) AS n, avg(prob) AS mp, avg(y_true) AS my FROM bn GROUP BY ALL),
bt AS (SELECT task_name, feature_set, count(*) AS total FROM p GROUP BY ALL),
ece AS (SELECT task_name, feature_set, round(sum(n / total * abs(mp - my)), 6) AS ece, round(sum(n / total * mp), 6) AS mean_predicted_probability,
   round(sum(n / total * my), 6) AS observed_positive_rate FROM be JOIN bt USING (task_name, feature_set) GROUP BY ALL)"""


@query("a31_calibration_error", f"{P}{ECE} SELECT * FROM ece")
def calibration_error(spark, sf):
    return rounded(M.calibration_error(I.predictions(spark, sf), KEYS, "prob", "y_true"))


@query("a32_calibration_summary", f"""{P}{ECE}{STEPS.format(keys='task_name, feature_set', score='prob', src='p')},
r AS (SELECT task_name, feature_set, {AUC} AS roc_auc, {AP} AS average_precision FROM steps GROUP BY ALL),
b AS (SELECT task_name, feature_set, round(avg((prob - y_true) * (prob - y_true)), 6) AS brier_score,
  count(*) FILTER (prob >= 0.8 AND y_true <> 1) AS high_confidence_error_count,
  count(*) FILTER (prob <= 0.2 AND y_true = 0) AS low_confidence_correct_count FROM p GROUP BY ALL)
SELECT * FROM b JOIN r USING (task_name, feature_set) JOIN ece USING (task_name, feature_set)""")
def calibration_summary(spark, sf):
    return rounded(M.calibration_summary(I.predictions(spark, sf), KEYS, "prob", "y_true"))


@query("a33_score_distribution", f"""{P} SELECT task_name, feature_set, y_true AS y_true_group, count(*) AS count, round(min(prob), 6) AS min_probability,
  round(quantile_cont(prob, 0.1), 6) AS q10_probability, round(quantile_cont(prob, 0.25), 6) AS q25_probability,
  round(quantile_cont(prob, 0.5), 6) AS median_probability, round(quantile_cont(prob, 0.75), 6) AS q75_probability,
  round(quantile_cont(prob, 0.9), 6) AS q90_probability, round(max(prob), 6) AS max_probability,
  round(avg(prob), 6) AS mean_probability, round(stddev_pop(prob), 6) AS std_probability FROM p GROUP BY ALL""")
def score_distribution(spark, sf):
    df = I.predictions(spark, sf).withColumnRenamed("y_true", "y_true_group")
    return rounded(M.score_distribution(df, [*KEYS, "y_true_group"], "prob"))


REVIEW_TAIL = """, e AS (SELECT task_name, feature_set, count(*) FILTER (y_true = 0 AND prob >= 0.5) AS false_positive_count,
   count(*) FILTER (y_true = 1 AND prob < 0.5) AS false_negative_count,
   round(count(*) FILTER (y_true = 0 AND prob >= 0.5) / nullif(count(*) FILTER (y_true = 0), 0), 6) AS clean_false_positive_rate
   FROM p GROUP BY ALL)
SELECT task_name, feature_set, false_positive_count + false_negative_count AS error_count, false_positive_count, false_negative_count,
  clean_false_positive_rate, CASE WHEN ece <= 0.05 THEN 'good_candidate' WHEN ece <= 0.10 THEN 'caution' ELSE 'weak' END AS calibration_quality,
  CASE WHEN false_positive_count + false_negative_count = 0 THEN 'caution_candidate' WHEN clean_false_positive_rate <= 0.10 THEN 'yes_candidate'
       WHEN clean_false_positive_rate <= 0.20 THEN 'caution_candidate' ELSE 'no' END AS recommended
FROM e JOIN ece USING (task_name, feature_set)"""


@query("a34_task_review", f"{P}{ECE}{REVIEW_TAIL}")
def task_review(spark, sf):
    df = I.predictions(spark, sf)
    p, y = F.col("prob"), F.col("y_true")
    counts = df.groupBy(*KEYS).agg(
        F.count_if((y == 0) & (p >= 0.5)).alias("false_positive_count"),
        F.count_if((y == 1) & (p < 0.5)).alias("false_negative_count"),
        F.count_if(y == 0).alias("_neg"))
    ece = M.calibration_error(df, KEYS, "prob", "y_true").select(*KEYS, F.round("ece", 6).alias("ece"))
    fpr = F.round(M.ratio(F.col("false_positive_count"), F.col("_neg")), 6)
    errors = F.col("false_positive_count") + F.col("false_negative_count")
    return join_keys(counts, ece, KEYS).select(
        *KEYS, errors.alias("error_count"), "false_positive_count", "false_negative_count",
        fpr.alias("clean_false_positive_rate"),
        F.when(F.col("ece") <= 0.05, "good_candidate").when(F.col("ece") <= 0.10, "caution")
        .otherwise("weak").alias("calibration_quality"),
        F.when(errors == 0, "caution_candidate").when(fpr <= 0.10, "yes_candidate")
        .when(fpr <= 0.20, "caution_candidate").otherwise("no").alias("recommended"))


@query("a35_band_cutpoints", f"""{P}, q AS (SELECT task_name, count(*) FILTER (y_true = 0) AS nn, count(*) FILTER (y_true = 1) AS np,
   quantile_cont(CASE WHEN y_true = 0 THEN prob END, 0.9) AS q90, quantile_cont(CASE WHEN y_true = 1 THEN prob END, 0.25) AS q25 FROM p GROUP BY ALL),
l AS (SELECT *, CASE WHEN nn >= 5 THEN q90 ELSE greatest(0.33, 0.55 * 0.5)::DOUBLE END AS low,
   CASE WHEN np >= 3 AND nn >= 3 THEN q25 ELSE 0.55::DOUBLE END AS med FROM q)
SELECT task_name, round(low, 4) AS low_max, round(greatest(low + 0.05::DOUBLE, least(med, 0.99::DOUBLE)), 4) AS medium_max,
  0.55::DOUBLE AS threshold FROM l""")
def band_cutpoints(spark, sf):
    return M.band_cutpoints(I.predictions(spark, sf), ["task_name"], "prob", "y_true", 0.55)
