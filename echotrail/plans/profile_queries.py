"""Manifest statistics, audits, balances and feature descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.operators import profile as R
from echotrail.operators.metrics import ratio
from echotrail.operators.ranges import bracket_stats
from echotrail.operators.skew import join_ids, merge_rows
from echotrail.plans import inputs as I
from echotrail.plans.metric_queries import rounded
from echotrail.plans.registry import query

M = f"WITH m AS ({I.MANIFEST_SQL})"
MISS = "CASE WHEN trim(coalesce({c}, '')) = '' THEN '<missing>' ELSE trim({c}) END"
DIMS = ["label", "attack_type", "dataset", "domain", "source"]


def long_sql(cols, src="m", extra=""):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {MISS.format(c=c)} AS value{extra} FROM {src}" for c in cols)


@query("a1_group_count", f"{M} SELECT speaker_id, dataset, label, count(*) AS count FROM m GROUP BY ALL")
def group_count(spark, sf):
    return I.manifest(spark, sf).groupBy("speaker_id", "dataset", "label").count()


@query("a2_value_counts_percent", f"""{M}, l AS ({long_sql(DIMS)}), c AS (SELECT dimension, value, count(*) AS count FROM l GROUP BY ALL)
SELECT *, round(100.0::DOUBLE * count / sum(count) OVER (PARTITION BY dimension), 4) AS pct FROM c""")
def value_counts(spark, sf):
    return R.value_counts(I.manifest(spark, sf), DIMS)


@query("a3_distinct_speakers", f"{M} SELECT dataset, count(DISTINCT speaker_id) AS speakers FROM m GROUP BY dataset")
def distinct_speakers(spark, sf):
    return I.manifest(spark, sf).groupBy("dataset").agg(F.countDistinct("speaker_id").alias("speakers"))


DOMAINS = ["studio", "podcast", "phone", "attic"]


@query("a4_crosstab", f"""{M} SELECT dataset, """ + ", ".join(
    f"count(*) FILTER (domain = '{d}') AS {d}" for d in DOMAINS) + " FROM m GROUP BY dataset")
def crosstab(spark, sf):
    return (I.manifest(spark, sf).groupBy("dataset").pivot("domain", DOMAINS).count()
            .na.fill(0, DOMAINS))


@query("a5_manifest_statistics", f"""{M}, n AS (SELECT count(*) AS total, count(DISTINCT speaker_id) AS speakers,
   count(*) FILTER (label = 'bonafide') AS real_n, count(*) FILTER (label = 'spoof') AS fake_n,
   avg(duration) AS d_mean, quantile_cont(duration, 0.5) AS d_median, min(duration) AS d_min, max(duration) AS d_max, stddev_samp(duration) AS d_std FROM m),
r AS (SELECT unnest([{{'metric': 'total_samples', 'value': total::DOUBLE}}, {{'metric': 'total_speakers', 'value': speakers::DOUBLE}},
  {{'metric': 'real_ratio', 'value': real_n / (real_n + fake_n)}}, {{'metric': 'fake_ratio', 'value': fake_n / (real_n + fake_n)}},
  {{'metric': 'duration_mean', 'value': d_mean}}, {{'metric': 'duration_median', 'value': d_median}}, {{'metric': 'duration_min', 'value': d_min}},
  {{'metric': 'duration_max', 'value': d_max}}, {{'metric': 'duration_std', 'value': d_std}}]) AS s FROM n)
SELECT 'overall' AS section, s.metric AS item, round(s.value, 6) AS value FROM r
UNION ALL SELECT dimension, value, count(*)::DOUBLE FROM ({long_sql(DIMS)}) GROUP BY ALL
UNION ALL SELECT 'speakers_per_dataset', dataset, count(DISTINCT speaker_id)::DOUBLE FROM m GROUP BY ALL""")
def manifest_statistics(spark, sf):
    m = I.manifest(spark, sf).withColumn("scope", F.lit("all"))
    base = bracket_stats(m, ["scope"], [
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "bonafide").alias("real_n"),
        F.count_if(F.col("label") == "spoof").alias("fake_n"), F.avg("duration").alias("duration_mean"),
        F.min("duration").alias("duration_min"), F.max("duration").alias("duration_max"),
        F.stddev_samp("duration").alias("duration_std")], {"duration_median": ("duration", 0.5)})
    speakers = m.groupBy("scope").agg(F.countDistinct("speaker_id").alias("speakers"))
    w = merge_rows(["scope"], base, speakers)
    both = F.col("real_n") + F.col("fake_n")
    cells = {"total_samples": F.col("total"), "total_speakers": F.col("speakers"),
             "real_ratio": ratio(F.col("real_n"), both), "fake_ratio": ratio(F.col("fake_n"), both),
             **{c: F.col(c) for c in ("duration_mean", "duration_median", "duration_min",
                                      "duration_max", "duration_std")}}
    overall = w.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("item"), F.round(v.cast("double"), 6).alias("value"))
        for k, v in cells.items()])).alias("s")).select(F.lit("overall").alias("section"), "s.*")
    counts = R.value_counts(m, DIMS).select(
        F.col("dimension").alias("section"), F.col("value").alias("item"),
        F.col("count").cast("double").alias("value"))
    per = m.groupBy("dataset").agg(F.countDistinct("speaker_id").cast("double").alias("value")).select(
        F.lit("speakers_per_dataset").alias("section"), F.col("dataset").alias("item"), "value")
    return overall.unionByName(counts).unionByName(per)


@query("a6_split_statistics", f"""{M} SELECT split, CASE WHEN grouping(dataset) = 0 THEN 'dataset' WHEN grouping(label) = 0 THEN 'label'
  WHEN grouping(attack_type) = 0 THEN 'attack_type' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'total' END AS dimension,
  coalesce(dataset, label, attack_type, domain) AS value, count(*) AS n, round(count(*) FILTER (label = 'bonafide') / count(*), 6) AS real_ratio
FROM m GROUP BY GROUPING SETS ((split), (split, dataset), (split, label), (split, attack_type), (split, domain))""")
def split_statistics(spark, sf):
    cols = [F.col(c) for c in ("split", "dataset", "label", "attack_type", "domain")]
    split, dataset, label, attack, domain = cols
    g = (I.manifest(spark, sf).withColumn("real", (label == "bonafide").cast("int"))
         .groupingSets([[split], [split, dataset], [split, label], [split, attack], [split, domain]], *cols)
         .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("real"), 6).alias("real_ratio"),
              F.grouping("dataset").alias("gd"), F.grouping("label").alias("gl"),
              F.grouping("attack_type").alias("ga"), F.grouping("domain").alias("gm")))
    return g.select("split", F.when(F.col("gd") == 0, "dataset").when(F.col("gl") == 0, "label")
                    .when(F.col("ga") == 0, "attack_type").when(F.col("gm") == 0, "domain")
                    .otherwise("total").alias("dimension"),
                    F.coalesce("dataset", "label", "attack_type", "domain").alias("value"), "n", "real_ratio")


@query("a7_mode_per_speaker", f"""{M}, c AS (SELECT speaker_id, dataset, count(*) AS n FROM m GROUP BY ALL),
d AS (SELECT speaker_id, label, count(*) AS n FROM m GROUP BY ALL)
SELECT speaker_id, (SELECT dataset FROM c WHERE c.speaker_id = s.speaker_id ORDER BY n DESC, dataset LIMIT 1) AS dataset,
  (SELECT label FROM d WHERE d.speaker_id = s.speaker_id ORDER BY n DESC, label LIMIT 1) AS label
FROM (SELECT DISTINCT speaker_id FROM m) s""")
def mode_per_speaker(spark, sf):
    m = I.manifest(spark, sf)
    return join_ids(R.mode_per_group(m, ["speaker_id"], "dataset", "dataset"),
                     R.mode_per_group(m, ["speaker_id"], "label", "label"), ["speaker_id"])


BUCKET = """CASE WHEN d < 0 THEN 'unknown' WHEN d < 1 THEN 'lt_1s' WHEN d < 2 THEN '1_2s' WHEN d < 4 THEN '2_4s' WHEN d < 8 THEN '4_8s'
  WHEN d < 15 THEN '8_15s' WHEN d < 30 THEN '15_30s' ELSE 'gt_30s' END"""
# Duration buckets, half-open [low, high) in seconds (fixed values).
DURATION_BUCKETS = [("lt_1s", 0.0, 1.0), ("1_2s", 1.0, 2.0), ("2_4s", 2.0, 4.0), ("4_8s", 4.0, 8.0),
                    ("8_15s", 8.0, 15.0), ("15_30s", 15.0, 30.0), ("gt_30s", 30.0, float("inf"))]


def duration_bucket(d):
    out = F.when(d < 0, "unknown")
    for name, low, high in DURATION_BUCKETS:
        out = out.when((d >= low) & (d < high), name)
    return out.otherwise("unknown")


@query("a8_manifest_profile", f"""{M}, s AS (SELECT count(*) AS total_rows, count(DISTINCT filepath) AS unique_files, count(DISTINCT speaker_id) AS speakers,
   count(*) FILTER (trim(coalesce(label, '')) = '') AS missing_label, count(*) FILTER (trim(coalesce(attack_type, '')) = '') AS missing_attack,
   count(*) FILTER (duration IS NULL OR duration < 0) AS missing_duration, sum(duration) AS dsum, min(duration) AS dmin, max(duration) AS dmax,
   quantile_cont(duration, 0.5) AS dmed FROM m),
u AS (SELECT unnest([{{'k': 'total_rows', 'v': total_rows::DOUBLE}}, {{'k': 'unique_files', 'v': unique_files::DOUBLE}}, {{'k': 'speakers', 'v': speakers::DOUBLE}},
  {{'k': 'missing_label', 'v': missing_label::DOUBLE}}, {{'k': 'missing_attack', 'v': missing_attack::DOUBLE}}, {{'k': 'missing_duration', 'v': missing_duration::DOUBLE}},
  {{'k': 'duration_sum', 'v': dsum}}, {{'k': 'duration_min', 'v': dmin}}, {{'k': 'duration_max', 'v': dmax}}, {{'k': 'duration_median', 'v': dmed}}]) AS s FROM s)
SELECT 'summary' AS section, s.k AS item, round(s.v, 4) AS value FROM u
UNION ALL SELECT dimension, value, count(*)::DOUBLE FROM ({long_sql(DIMS)}) GROUP BY ALL
UNION ALL SELECT 'duration_bucket', {BUCKET}, count(*)::DOUBLE FROM (SELECT duration AS d FROM m WHERE duration IS NOT NULL) GROUP BY ALL""")
def manifest_profile(spark, sf):
    m = I.manifest(spark, sf).withColumn("scope", F.lit("all"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    d = F.col("duration")
    base = bracket_stats(m, ["scope"], [
        F.count(F.lit(1)).alias("total_rows"), F.count_if(blank("label")).alias("missing_label"),
        F.count_if(blank("attack_type")).alias("missing_attack"),
        F.count_if(d.isNull() | (d < 0)).alias("missing_duration"), F.sum(d).alias("duration_sum"),
        F.min(d).alias("duration_min"), F.max(d).alias("duration_max")], {"duration_median": ("duration", 0.5)})
    uniq = m.groupBy("scope").agg(F.countDistinct("filepath").alias("unique_files"),
                                  F.countDistinct("speaker_id").alias("speakers"))
    wide = merge_rows(["scope"], base, uniq).drop("scope")
    summary = R.unpivot(wide, wide.columns, (), "item", "value", "double").select(
        F.lit("summary").alias("section"), "item", F.round("value", 4).alias("value"))
    long = R.value_counts(m, DIMS).select(F.col("dimension").alias("section"), F.col("value").alias("item"),
                                          F.col("count").cast("double").alias("value"))
    buckets = (m.where(d.isNotNull()).groupBy(duration_bucket(d).alias("item")).count()
               .select(F.lit("duration_bucket").alias("section"), "item",
                       F.col("count").cast("double").alias("value")))
    return summary.unionByName(long).unionByName(buckets)


BAL = f"""{M}, l AS ({long_sql(DIMS, extra=', filepath')}), t AS (SELECT count(*) AS rows, count(DISTINCT filepath) AS files FROM m),
b AS (SELECT dimension, value, count(*) AS row_count, count(DISTINCT filepath) AS unique_file_count FROM l GROUP BY ALL),
bal AS (SELECT dimension, value, row_count, unique_file_count, round(100.0::DOUBLE * row_count / rows, 4) AS row_pct,
  round(100.0::DOUBLE * unique_file_count / files, 4) AS file_pct, round(row_count / greatest(unique_file_count, 1), 4) AS avg_rows_per_file FROM b, t)"""
RISK = BAL + """, w AS (SELECT *, min(avg_rows_per_file) OVER (PARTITION BY dimension) AS lo, max(avg_rows_per_file) OVER (PARTITION BY dimension) AS hi,
   avg(avg_rows_per_file) OVER (PARTITION BY dimension) AS mean FROM bal),
risk AS (SELECT dimension, value, row_count, unique_file_count, row_pct, file_pct, avg_rows_per_file,
  CASE WHEN avg_rows_per_file >= mean * 2.5::DOUBLE AND hi / lo > 2 THEN 'high' WHEN avg_rows_per_file >= mean * 1.75::DOUBLE AND hi / lo > 1.5 THEN 'medium'
       WHEN hi / lo > 3 THEN 'high' WHEN hi / lo > 1.75 THEN 'medium' ELSE 'low' END AS weighting_bias_risk FROM w)"""


@query("a9_file_balance", BAL + " SELECT * FROM bal")
def file_balance(spark, sf):
    return R.file_balance(I.manifest(spark, sf), "filepath", DIMS)


@query("a10_weighting_bias", RISK + " SELECT * FROM risk")
def weighting_bias(spark, sf):
    return R.weighting_bias(R.file_balance(I.manifest(spark, sf), "filepath", DIMS))


@query("a11_balance_summary", RISK + """ SELECT CASE WHEN count(*) FILTER (weighting_bias_risk = 'high') > 0 THEN 'high'
   WHEN count(*) FILTER (weighting_bias_risk = 'medium') > 0 THEN 'medium' ELSE 'low' END AS severity,
  first(dimension || '=' || value ORDER BY avg_rows_per_file DESC, row_count DESC, dimension DESC, value DESC) AS top_group,
  max(avg_rows_per_file) AS top_avg_rows_per_file, count(*) FILTER (weighting_bias_risk = 'high') AS high_risk_groups,
  count(*) FILTER (weighting_bias_risk = 'medium') AS medium_risk_groups,
  first(value ORDER BY row_count DESC, value DESC) FILTER (dimension = 'dataset') AS top_dataset,
  max(row_pct) FILTER (dimension = 'dataset') AS top_dataset_pct FROM risk""")
def balance_summary(spark, sf):
    r = R.weighting_bias(R.file_balance(I.manifest(spark, sf), "filepath", DIMS))
    risk, ds = F.col("weighting_bias_risk"), F.col("dimension") == "dataset"
    return r.agg(
        F.count_if(risk == "high").alias("high_risk_groups"), F.count_if(risk == "medium").alias("medium_risk_groups"),
        F.max(F.struct("avg_rows_per_file", "row_count", "dimension", "value")).alias("t"),
        F.max("avg_rows_per_file").alias("top_avg_rows_per_file"),
        F.max(F.when(ds, F.struct("row_count", "value", "row_pct"))).alias("d"),
    ).select(F.when(F.col("high_risk_groups") > 0, "high").when(F.col("medium_risk_groups") > 0, "medium")
             .otherwise("low").alias("severity"),
             F.concat("t.dimension", F.lit("="), "t.value").alias("top_group"), "top_avg_rows_per_file",
             "high_risk_groups", "medium_risk_groups", F.col("d.value").alias("top_dataset"),
             F.col("d.row_pct").alias("top_dataset_pct"))


@query("a12_duplicate_report", f"""WITH m0 AS ({I.MANIFEST_SQL}), m AS (SELECT 'item_' || file_id AS filepath, label, attack_type FROM m0),
g AS (SELECT filepath, count(*) AS count, list_sort(list(DISTINCT {MISS.format(c='label')})) AS ls, list_sort(list(DISTINCT {MISS.format(c='attack_type')})) AS las
   FROM m GROUP BY filepath HAVING count(*) > 1)
SELECT CASE WHEN len(ls) > 1 THEN 'duplicate_filepath_multi_label' WHEN len(las) > 1 THEN 'duplicate_filepath_multi_attack' ELSE 'duplicate_filepath' END AS issue,
  filepath, count, array_to_string(ls, '|') AS labels, array_to_string(las, '|') AS attack_types FROM g""")
def duplicate_report(spark, sf):
    m = I.manifest(spark, sf).withColumn("filepath", F.concat(F.lit("item_"), "file_id"))
    return R.duplicate_report(m, "filepath", "label", "attack_type")


# Recording domains counted as known (fixed values).
KNOWN_DOMAINS = ["studio", "read_speech", "broadcast", "podcast", "social", "synthetic",
                 "phone", "whatsapp", "urdu", "pakistani"]
KD = ", ".join(f"'{d}'" for d in KNOWN_DOMAINS)


@query("a13_label_conflicts", f"""{M}, t AS (SELECT doc_id, filepath, trim(coalesce(label, '')) AS l, trim(coalesce(attack_type, '')) AS a, trim(coalesce(domain, '')) AS d FROM m)
SELECT doc_id, filepath, 'missing_label' AS issue FROM t WHERE l = ''
UNION ALL SELECT doc_id, filepath, 'bonafide_label_non_bonafide_attack' FROM t WHERE l = 'bonafide' AND a <> 'bonafide' AND a <> ''
UNION ALL SELECT doc_id, filepath, 'spoof_label_bonafide_attack' FROM t WHERE l IN ('spoof', 'fake') AND a = 'bonafide'
UNION ALL SELECT doc_id, filepath, 'missing_attack_type' FROM t WHERE a = ''
UNION ALL SELECT doc_id, filepath, 'unknown_domain' FROM t WHERE d <> '' AND lower(d) NOT IN ({KD})""")
def label_conflicts(spark, sf):
    label, attack, domain = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("label", "attack_type", "domain"))
    return R.issue_rows(I.manifest(spark, sf), {
        "missing_label": label == "",
        "bonafide_label_non_bonafide_attack": (label == "bonafide") & (attack != "bonafide") & (attack != ""),
        "spoof_label_bonafide_attack": label.isin("spoof", "fake") & (attack == "bonafide"),
        "missing_attack_type": attack == "",
        "unknown_domain": (domain != "") & ~F.lower(domain).isin(KNOWN_DOMAINS),
    }, ["doc_id", "filepath"])


LEAK_ITEMS = [("duplicate_file_id", "blocking"), ("duplicate_audio_path", "warning"),
              ("conflicting_task_labels", "blocking"), ("source_group_multiple_variants", "warning"),
              ("source_group_cross_split", "blocking"), ("segment_same_file_split_risk", "warning"),
              ("origin_vs_manipulation_coupling", "warning"), ("partial_inherited_label_risk", "warning")]
LEAK_VALUES = ", ".join(f"('{i}', '{s}')" for i, s in LEAK_ITEMS)


@query("a14_leakage_audit", f"""WITH f AS (SELECT 'item_' || CAST(doc_id % 900 AS VARCHAR) AS file_id, '/audio/' || CAST(doc_id % 950 AS VARCHAR) || '.wav' AS audio_path,
   'g' || CAST(doc_id % 300 AS VARCHAR) AS source_group_id, CASE WHEN doc_id % 7 = 0 THEN 'val' ELSE 'train' END AS split,
   doc_id % 5 < 3 AS is_clean, doc_id % 13 = 0 AS is_replay, doc_id % 4 = 0 AS is_ai FROM documents),
s AS (SELECT CAST(l_orderkey AS VARCHAR) AS file_id, l_linestatus = 'F' AS partial, l_returnflag = 'R' AS stamped FROM lineitem),
h AS (SELECT 'duplicate_file_id' AS item, file_id AS id, count(*) AS n FROM f GROUP BY file_id HAVING count(*) > 1
 UNION ALL SELECT 'duplicate_audio_path', file_id, 1 FROM (SELECT *, count(*) OVER (PARTITION BY audio_path) AS c FROM f) WHERE c > 1
 UNION ALL SELECT 'conflicting_task_labels', file_id, 1 FROM f WHERE is_clean AND is_replay
 UNION ALL SELECT 'source_group_multiple_variants', source_group_id, 1 FROM f GROUP BY source_group_id HAVING count(*) > 1
 UNION ALL SELECT 'source_group_cross_split', source_group_id, 1 FROM f GROUP BY source_group_id HAVING count(DISTINCT split) > 1
 UNION ALL SELECT 'segment_same_file_split_risk', file_id, 1 FROM s GROUP BY file_id HAVING count(*) > 1
 UNION ALL SELECT 'origin_vs_manipulation_coupling', file_id, 1 FROM f WHERE is_ai AND is_replay
 UNION ALL SELECT 'partial_inherited_label_risk', file_id, count(*) FROM s WHERE partial AND NOT stamped GROUP BY file_id),
d AS (SELECT DISTINCT item, id FROM h),
c AS (SELECT item, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY item)
SELECT v.item AS audit_item, CASE WHEN coalesce(n, 0) > 0 THEN v.sev ELSE 'info' END AS severity, coalesce(n, 0) AS affected_count,
  d.id AS affected_id FROM (VALUES {LEAK_VALUES}) v(item, sev) LEFT JOIN c ON c.item = v.item LEFT JOIN d ON d.item = v.item""")
def leakage_audit(spark, sf):
    d = F.col("doc_id")
    f = I.table(spark, sf, "documents").select(
        F.concat(F.lit("item_"), (d % 900).cast("string")).alias("file_id"),
        F.concat(F.lit("/audio/"), (d % 950).cast("string"), F.lit(".wav")).alias("audio_path"),
        F.concat(F.lit("g"), (d % 300).cast("string")).alias("source_group_id"),
        F.when(d % 7 == 0, "val").otherwise("train").alias("split"),
        (d % 5 < 3).alias("is_clean"), (d % 13 == 0).alias("is_replay"), (d % 4 == 0).alias("is_ai"))
    s = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file_id"),
        (F.col("l_linestatus") == "F").alias("partial"), (F.col("l_returnflag") == "R").alias("stamped"))

    def hits(item, df, ident, n=F.lit(1).cast("long")):
        return df.select(F.lit(item).alias("item"), F.col(ident).alias("id"), n.alias("n"))

    many = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    k = F.col("k")
    one = F.lit(1).cast("long")
    twice = join_ids(f, many(f, "audio_path"), ["audio_path"])
    # distinct (group, split) first: a group's rows never meet in one task
    across = many(f.select("source_group_id", "split").distinct(), "source_group_id")
    inherited = s.where(F.col("partial") & ~F.col("stamped")).groupBy("file_id").agg(F.count(F.lit(1)).alias("k"))
    parts = [
        hits("duplicate_file_id", many(f, "file_id"), "file_id", k),
        hits("duplicate_audio_path", twice, "file_id", one),
        hits("conflicting_task_labels", f.where("is_clean AND is_replay"), "file_id", one),
        hits("source_group_multiple_variants", many(f, "source_group_id"), "source_group_id", one),
        hits("source_group_cross_split", across, "source_group_id", one),
        hits("segment_same_file_split_risk", many(s, "file_id"), "file_id", one),
        hits("origin_vs_manipulation_coupling", f.where("is_ai AND is_replay"), "file_id", one),
        hits("partial_inherited_label_risk", inherited, "file_id", k)]
    allhits = parts[0]
    for p in parts[1:]:
        allhits = allhits.unionByName(p)
    counts = allhits.groupBy("item").agg(F.sum("n").alias("n"))
    named = spark.createDataFrame(LEAK_ITEMS, "item string, sev string")
    out = join_ids(join_ids(named, counts, ["item"], "left"), allhits.select("item", "id").distinct(), ["item"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(F.col("item").alias("audit_item"), F.when(n > 0, F.col("sev")).otherwise("info").alias("severity"),
                      n.alias("affected_count"), F.col("id").alias("affected_id"))


@query("a15_dataset_summary", f"""{M} SELECT 'row_count' AS metric, 'rows' AS key, count(*) AS value FROM m
UNION ALL SELECT 'label_count', dimension || '=' || value, count(*) FROM ({long_sql(['label', 'attack_type', 'split'])}) GROUP BY ALL""")
def dataset_summary(spark, sf):
    m = I.manifest(spark, sf)
    counts = R.value_counts(m, ["label", "attack_type", "split"]).select(
        F.lit("label_count").alias("metric"), F.concat("dimension", F.lit("="), "value").alias("key"),
        F.col("count").alias("value"))
    rows = m.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("row_count").alias("metric"), F.lit("rows").alias("key"), "value")
    return rows.unionByName(counts)


SOURCE_TYPE = """CASE WHEN y_true = 1 THEN NULL WHEN file_category IN ('ai_fabricated', 'human_fabricated') THEN 'fabricated_outside_same_file'
  WHEN file_category = 'ai_direct' THEN 'clean_direct_negative' WHEN file_category = 'ai_replay' THEN 'replay_negative' ELSE 'mixer_negative' END"""


@query("a16_training_balance", f"""WITH f AS ({I.FILES_SQL}), g AS ({I.SEGMENTS_SQL}),
s AS (SELECT g.file_id, y_true, file_category, {SOURCE_TYPE} AS src FROM g JOIN f USING (file_id)),
fc AS (SELECT count(*) AS file_gate_total_rows, count(*) FILTER (file_category IN ('ai_fabricated', 'human_fabricated')) AS file_gate_positive_count FROM f),
sc AS (SELECT count(*) AS segment_total_rows, count(*) FILTER (y_true = 1) AS segment_positive_count, count(*) FILTER (y_true = 0) AS segment_negative_count,
  count(*) FILTER (src = 'clean_direct_negative') AS segment_negative_clean_count, count(*) FILTER (src = 'replay_negative') AS segment_negative_replay_count,
  count(*) FILTER (src = 'mixer_negative') AS segment_negative_mixer_count, count(*) FILTER (src = 'fabricated_outside_same_file') AS segment_negative_outside_count,
  count(*) FILTER (y_true = 1 AND file_category = 'ai_fabricated') AS ai_fabricated_positive_segment_count,
  count(*) FILTER (y_true = 1 AND file_category = 'human_fabricated') AS human_fabricated_positive_segment_count,
  count(DISTINCT file_id) FILTER (y_true = 1) AS files_with_positive_segments,
  count(DISTINCT file_id) FILTER (file_category IN ('ai_fabricated', 'human_fabricated')) AS partial_files FROM s)
SELECT file_gate_total_rows, file_gate_positive_count, file_gate_total_rows - file_gate_positive_count AS file_gate_negative_count, sc.* EXCLUDE (partial_files),
  greatest(partial_files - files_with_positive_segments, 0) AS files_without_positive_segments,
  concat_ws('; ', CASE WHEN segment_negative_outside_count = 0 THEN 'no_outside_same_partial_negatives' END, CASE WHEN segment_negative_clean_count = 0 THEN 'no_clean_direct_negatives' END,
   CASE WHEN partial_files - files_with_positive_segments > 0 THEN 'partial_files_without_positive_segments=' || CAST(partial_files - files_with_positive_segments AS VARCHAR) END) AS warnings FROM fc, sc""")
def training_balance(spark, sf):
    f = I.files(spark, sf).select("file_id", "file_category")
    partial = F.col("file_category").isin("ai_fabricated", "human_fabricated")
    gate = f.agg(F.count(F.lit(1)).alias("file_gate_total_rows"), F.count_if(partial).alias("file_gate_positive_count"))
    s = join_ids(I.segments(spark, sf).select("file_id", "y_true"), f, ["file_id"])
    y, cat = F.col("y_true"), F.col("file_category")
    # one row per file first: flags and counts, then the totals
    per_file = s.groupBy("file_id", "file_category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("q"))
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    seg = per_file.agg(
        F.sum("n").alias("segment_total_rows"), F.sum("p").alias("segment_positive_count"),
        F.sum("q").alias("segment_negative_count"),
        total(cat == "ai_direct", "q").alias("segment_negative_clean_count"),
        total(cat == "ai_replay", "q").alias("segment_negative_replay_count"),
        total(cat == "ai_mixer", "q").alias("segment_negative_mixer_count"),
        total(partial, "q").alias("segment_negative_outside_count"),
        total(cat == "ai_fabricated", "p").alias("ai_fabricated_positive_segment_count"),
        total(cat == "human_fabricated", "p").alias("human_fabricated_positive_segment_count"),
        F.count_if(F.col("p") > 0).alias("files_with_positive_segments"),
        F.count_if(partial).alias("_partial"))
    j = merge_rows(["_k"], gate.withColumn("_k", F.lit(1)), seg.withColumn("_k", F.lit(1)))
    without = F.col("_partial") - F.col("files_with_positive_segments")
    warn = F.concat_ws(
        "; ", F.when(F.col("segment_negative_outside_count") == 0, "no_outside_same_partial_negatives"),
        F.when(F.col("segment_negative_clean_count") == 0, "no_clean_direct_negatives"),
        F.when(without > 0, F.concat(F.lit("partial_files_without_positive_segments="), without.cast("string"))))
    return j.select(
        "file_gate_total_rows", "file_gate_positive_count",
        (F.col("file_gate_total_rows") - F.col("file_gate_positive_count")).alias("file_gate_negative_count"),
        *[c for c in seg.columns if c != "_partial"],
        F.greatest(without, F.lit(0)).alias("files_without_positive_segments"), warn.alias("warnings"))


# Features ------------------------------------------------------------------------------

FEATURES = I.FEATURES
FEAT = """WITH g AS (SELECT file_id, y_true, f_quantity, f_price, f_discount, CASE WHEN f_tax = 0 THEN NULL ELSE f_tax END AS f_tax, start_sec FROM (""" + I.SEGMENTS_SQL + ")),"
FEAT_LONG = " UNION ALL ".join(f"SELECT file_id, y_true, start_sec, '{f}' AS feature, {f} AS x FROM g" for f in FEATURES)
STATS = """count(x) AS count, count(*) AS row_count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
  round(max(x), 4) AS max, round(quantile_cont(x, 0.5), 4) AS median, round(100.0::DOUBLE * (1 - count(x) / greatest(count(*), 1)), 4) AS missing_percent"""


def with_missing(spark, sf):
    return I.segments(spark, sf).withColumn("f_tax", F.when(F.col("f_tax") != 0, F.col("f_tax")))


@query("a36_feature_summary", f"{FEAT} l AS ({FEAT_LONG}) SELECT y_true, feature, {STATS} FROM l GROUP BY ALL")
def feature_summary(spark, sf):
    long = R.feature_long(with_missing(spark, sf), FEATURES, ["y_true"])
    return rounded(R.feature_summary(long, ["y_true"]), 4)


@query("a37_feature_missingness", f"""{FEAT} l AS ({FEAT_LONG} UNION ALL SELECT file_id, y_true, start_sec, 'f_constant', 1::DOUBLE FROM g),
a AS (SELECT feature, round(100.0::DOUBLE * (1 - count(x) / count(*)), 4) AS missing_percent, count(x) AS non_null_count, count(*) AS row_count, round(var_samp(x), 4) AS variance FROM l GROUP BY ALL)
SELECT *, CASE WHEN missing_percent >= 100 THEN 'exclude_for_now' WHEN missing_percent > 50 THEN 'limited' WHEN variance = 0 THEN 'exclude_for_now' ELSE 'usable' END AS usability FROM a""")
def feature_missingness(spark, sf):
    df = with_missing(spark, sf).withColumn("f_constant", F.lit(1.0))
    return rounded(R.missingness(R.feature_long(df, [*FEATURES, "f_constant"])), 4)


EFFECT = """st AS (SELECT comparison_name, feature, side, count(*) AS n, count(x) AS k, avg(x) AS m, var_samp(x) AS v, quantile_cont(x, 0.5) AS md FROM l GROUP BY ALL),
w AS (SELECT comparison_name, feature, coalesce(max(n) FILTER (side = 'a'), 0) AS na, coalesce(max(n) FILTER (side = 'b'), 0) AS nb, coalesce(max(k) FILTER (side = 'a'), 0) AS ka, coalesce(max(k) FILTER (side = 'b'), 0) AS kb,
   max(m) FILTER (side = 'a') AS ma, max(m) FILTER (side = 'b') AS mb, max(md) FILTER (side = 'a') AS mda, max(md) FILTER (side = 'b') AS mdb,
   sqrt((coalesce(max(v) FILTER (side = 'a'), 0) + coalesce(max(v) FILTER (side = 'b'), 0)) / 2) AS pooled FROM st GROUP BY ALL)
SELECT comparison_name, feature, na AS group_a_count, nb AS group_b_count, round(ma, 4) AS group_a_mean, round(mb, 4) AS group_b_mean, round(mda, 4) AS group_a_median, round(mdb, 4) AS group_b_median,
  round(abs(ma - mb), 4) AS abs_mean_difference, CASE WHEN na >= 5 AND nb >= 5 AND pooled > 0 THEN round(abs(ma - mb) / pooled, 4) END AS effect_size,
  round(100.0::DOUBLE * (1 - (ka + kb) / greatest(na + nb, 1)), 4) AS missing_percent,
  CASE WHEN na < 5 OR nb < 5 OR ma IS NULL OR mb IS NULL THEN 'insufficient_data' WHEN pooled > 0 AND ma > mb THEN 'higher_in_group_a' WHEN pooled > 0 AND mb > ma THEN 'higher_in_group_b' ELSE 'no_clear_direction' END AS direction FROM w"""


@query("a38_group_effects", f"""{FEAT} l0 AS ({FEAT_LONG}), l AS (
  SELECT 'marked_vs_rest' AS comparison_name, CASE WHEN y_true = 1 THEN 'a' ELSE 'b' END AS side, feature, x FROM l0
  UNION ALL SELECT 'early_vs_late', CASE WHEN start_sec < 6 THEN 'a' ELSE 'b' END, feature, x FROM l0 WHERE start_sec < 6 OR start_sec >= 8), {EFFECT}""")
def group_effects(spark, sf):
    y, s = F.col("y_true"), F.col("start_sec")
    out = R.compare_groups(with_missing(spark, sf), FEATURES, [
        ("marked_vs_rest", y == 1, y == 0), ("early_vs_late", s < 6, s >= 8)])
    return rounded(out, 4)


@query("a39_correlations", f"""{FEAT} c AS (SELECT corr(f_quantity, f_price) AS c1, corr(f_quantity, f_discount) AS c2, corr(f_discount, f_price) AS c3 FROM g)
SELECT feature_a, feature_b, round(r, 6) AS correlation, round(abs(r), 6) AS abs_correlation FROM c, LATERAL (VALUES ('f_price', 'f_quantity', c1), ('f_price', 'f_tax', (SELECT corr(f_price, f_tax) FROM g)),
  ('f_quantity', 'f_tax', (SELECT corr(f_quantity, f_tax) FROM g))) v(feature_a, feature_b, r)
UNION ALL SELECT 'f_price', 'f_discount', round(c3, 6), round(abs(c3), 6) FROM c UNION ALL SELECT 'f_quantity', 'f_discount', round(c2, 6), round(abs(c2), 6) FROM c
UNION ALL SELECT 'f_discount', 'f_tax', round(r, 6), round(abs(r), 6) FROM (SELECT corr(f_discount, f_tax) AS r FROM g)""")
def correlations(spark, sf):
    df = with_missing(spark, sf)
    return rounded(R.correlations(df, ["f_price", "f_quantity", "f_discount", "f_tax"], 10))


EMB = "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings), l0 AS (SELECT label, 'emb_' || lpad(CAST(d AS VARCHAR), 3, '0') AS feature, x FROM e),"


@query("a40_embedding_effects", f"{EMB} l AS (SELECT 'low_vs_high' AS comparison_name, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS side, feature, x FROM l0), {EFFECT}")
def embedding_effects(spark, sf):
    e = I.table(spark, sf, "embeddings").withColumn("_side", F.when(F.col("label") < 5, "a").otherwise("b"))
    long = R.vector_long(e, "embedding", ["_side"]).withColumn("comparison_name", F.lit("low_vs_high"))
    return rounded(R.group_effects(long, ["comparison_name"]), 4)


@query("a40_embedding_summary", f"{EMB} s AS (SELECT label, feature, {STATS} FROM l0 GROUP BY ALL) SELECT * FROM s")
def embedding_summary(spark, sf):
    long = R.vector_long(I.table(spark, sf, "embeddings"), "embedding", ["label"])
    return rounded(R.feature_summary(long, ["label"]), 4)


@query("a41_row_norms", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l2_norm,
  round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / len(embedding), 6) AS mean_abs_value,
  round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS max_abs_value, true AS finite_row FROM embeddings""")
def row_norms(spark, sf):
    return rounded(R.row_norms(I.table(spark, sf, "embeddings"), "vec_id", "embedding"))


@query("a73_class_weights", """WITH c AS (SELECT k AS class, greatest(count(l_orderkey), 1) AS class_count FROM range(5) r(k)
   LEFT JOIN lineitem ON CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 3 END = k GROUP BY k),
w AS (SELECT class, class_count, sum(class_count) OVER () / (5 * class_count) AS raw FROM c)
SELECT CAST(class AS INTEGER) AS class, class_count, round(raw / sum(raw) OVER () * 5, 6) AS weight FROM w""")
def class_weights(spark, sf):
    flag = F.col("l_returnflag")
    cls = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(3)
    return rounded(R.class_weights(I.table(spark, sf, "lineitem"), cls, 5))


WEIGHT = "CASE WHEN l_returnflag = 'R' THEN 2.5::DOUBLE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END"


@query("a74_weighted_balance", f"""WITH s AS (SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS risk_target, {WEIGHT} AS w FROM lineitem),
b AS (SELECT round(sum(w) FILTER (risk_target = 0), 2) AS w0, round(sum(w) FILTER (risk_target = 1), 2) AS w1 FROM s)
SELECT w0, w1, CASE WHEN w0 > 0 THEN round(w1 / w0, 6) END AS ratio_pos_to_neg, CASE WHEN w1 > 0 THEN round(w0 / w1, 6) END AS ratio_neg_to_pos FROM b""")
def weighted_balance(spark, sf):
    flag = F.col("l_returnflag")
    w = F.when(flag == "R", 2.5).when(flag == "A", 1.0).otherwise(0.7)
    pos = F.col("l_linestatus") == "F"
    b = I.table(spark, sf, "lineitem").agg(F.round(F.sum(F.when(~pos, w)), 2).alias("w0"),
                                           F.round(F.sum(F.when(pos, w)), 2).alias("w1"))
    return b.select("w0", "w1", F.round(ratio(F.col("w1"), F.col("w0")), 6).alias("ratio_pos_to_neg"),
                    F.round(ratio(F.col("w0"), F.col("w1")), 6).alias("ratio_neg_to_pos"))


@query("a75_weight_distribution", f"""{M} SELECT split, dataset, count(*) AS count, round(avg(duration), 6) AS mean, min(duration) AS min, max(duration) AS max FROM m GROUP BY ALL""")
def weight_distribution(spark, sf):
    return I.manifest(spark, sf).groupBy("split", "dataset").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("duration"), 6).alias("mean"),
        F.min("duration").alias("min"), F.max("duration").alias("max"))


@query("a76_split_summary", f"""WITH f AS ({I.FILES_SQL}), g AS ({I.SEGMENTS_SQL})
SELECT split, count(*) AS segment_rows, CAST(sum(y_true) AS BIGINT) AS positive_segments,
  count(DISTINCT CASE WHEN file_category IN ('ai_fabricated', 'human_fabricated') THEN file_id END) AS partial_files FROM g JOIN f USING (file_id) GROUP BY split""")
def split_summary(spark, sf):
    s = join_ids(I.segments(spark, sf).select("file_id", "y_true"),
                  I.files(spark, sf).select("file_id", "file_category", "split"), ["file_id"])
    partial = F.col("file_category").isin("ai_fabricated", "human_fabricated")
    per_file = s.groupBy("split", "file_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("p"), F.max(partial).alias("partial"))
    return per_file.groupBy("split").agg(F.sum("n").alias("segment_rows"), F.sum("p").alias("positive_segments"),
                                         F.count_if(F.col("partial")).alias("partial_files"))


@query("a77_array_sanity", """WITH x AS (SELECT vec_id, unnest(list_transform(embedding, lambda v, i: CASE WHEN i = 1 AND vec_id % 11 = 0 THEN 'nan'::DOUBLE
   WHEN i = 2 AND vec_id % 13 = 0 THEN 'inf'::DOUBLE ELSE v::DOUBLE END)) AS v FROM embeddings), f AS (SELECT *, isfinite(v) AS ok FROM x)
SELECT vec_id, count(*) FILTER (isnan(v)) AS nan_count, count(*) FILTER (isinf(v)) AS inf_count, round(min(v) FILTER (ok), 6) AS min, round(max(v) FILTER (ok), 6) AS max,
  round(avg(v) FILTER (ok), 6) AS mean, round(stddev_pop(CASE WHEN ok THEN v END), 6) AS std FROM f GROUP BY vec_id""")
def array_sanity(spark, sf):
    vec = F.col("vec_id")
    broken = F.transform("embedding", lambda v, i: F.when((i == 0) & (vec % 11 == 0), float("nan"))
                         .when((i == 1) & (vec % 13 == 0), float("inf")).otherwise(v.cast("double")))
    long = I.table(spark, sf, "embeddings").select("vec_id", F.explode(broken).alias("v"))
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    return rounded(long.groupBy("vec_id").agg(
        F.count_if(F.isnan("v")).alias("nan_count"),
        F.count_if(F.abs("v") == float("inf")).alias("inf_count"),
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"),
        F.stddev_pop(finite).alias("std")))
