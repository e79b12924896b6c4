"""Table checks, splits, samples, folds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import labels as L
from echotrail.functions import rules as R
from echotrail.operators import features as E
from echotrail.operators import joins as J
from echotrail.operators import models as ML
from echotrail.operators import newton as N
from echotrail.operators import quality as Q
from echotrail.operators import sampling as X
from echotrail.operators.profile import feature_long, issue_rows
from echotrail.operators.skew import join_ids, numbered, settled
from echotrail.plans import inputs as I
from echotrail.plans.metric_queries import rounded
from echotrail.plans.registry import query

c = F.col
MAN = f"WITH m AS ({I.MANIFEST_SQL})"
SEG = f"WITH f AS ({I.FILES_SQL}), g AS ({I.SEGMENTS_SQL})"

# Validation ------------------------------------------------------------------------------


def rules_sql(src, rules):
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, '{lv}' AS level, count(*) FILTER ({cond}) AS violations FROM {src}" for n, lv, cond in rules)


STATUS = "CASE WHEN violations = 0 THEN 'PASS' WHEN level = 'blocking' THEN 'FAIL' ELSE 'WARN' END AS status"


@query("v1_evidence_table_rules", f"""{SEG}, r AS (SELECT '' AS x), v AS ({rules_sql('f', [('blank_path', 'blocking', "trim(audio_path) = ''"), ('category_vocabulary', 'blocking', "file_category NOT IN ('ai_fabricated', 'human_fabricated', 'ai_direct', 'ai_replay')"), ('score_range', 'blocking', 'gate_prob < 0 OR gate_prob > 1'), ('missing_duration', 'warning', 'duration_sec IS NULL')])}
 UNION ALL {rules_sql('(SELECT g.*, duration_sec FROM g LEFT JOIN f USING (file_id))', [('end_not_after_start', 'blocking', 'end_sec <= start_sec'), ('end_past_duration', 'blocking', 'end_sec > duration_sec + 0.05')])}
 UNION ALL SELECT 'duplicate_file_id', 'blocking', count(*) FROM (SELECT file_id FROM f GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown_file_id', 'blocking', count(*) FROM (SELECT DISTINCT file_id FROM g WHERE file_id NOT IN (SELECT file_id FROM f WHERE dataset <> 'P')))
SELECT rule, level, violations, {STATUS} FROM v""")
def evidence_table_rules(spark, sf):
    f, g = I.files(spark, sf), I.segments(spark, sf)
    problems = Q.missing_columns(f, ["file_id", "audio_path", "gate_prob"], ["origin_score"])
    if problems:
        raise ValueError("; ".join(problems))
    per_file = Q.rule_counts(f, {
        "blank_path": ("blocking", F.trim("audio_path") == ""),
        "category_vocabulary": ("blocking", ~c("file_category").isin("ai_fabricated", "human_fabricated", "ai_direct", "ai_replay")),
        "score_range": ("blocking", (c("gate_prob") < 0) | (c("gate_prob") > 1)), "missing_duration": ("warning", c("duration_sec").isNull())})
    timed = join_ids(g.select("file_id", "start_sec", "end_sec"), f.select("file_id", "duration_sec"), ["file_id"], "left")
    per_seg = Q.rule_counts(timed, {"end_not_after_start": ("blocking", c("end_sec") <= c("start_sec")),
                                    "end_past_duration": ("blocking", c("end_sec") > c("duration_sec") + 0.05)})
    return (per_file.unionByName(per_seg).unionByName(Q.repeated_keys(f, "file_id", "duplicate_file_id"))
            .unionByName(Q.orphans(g, f.where(c("dataset") != "P"), "file_id", "unknown_file_id")))


@query("v2_disallowed_values", f"{MAN} SELECT coalesce(domain, '<null>') AS value, count(*) AS rows FROM m WHERE domain NOT IN ('studio', 'podcast') OR domain IS NULL GROUP BY 1")
def disallowed_values(spark, sf):
    return Q.disallowed_values(I.manifest(spark, sf), "domain", ["studio", "podcast"])


LABELS = ["human_likely", "ai_likely", "mixed_or_partial_ai"]
MLABELS = ["clean_original", "replayed_or_re_recorded", "channel_processed", "edited_or_spliced"]


@query("v3_label_consistency", f"""WITH r AS ({I.RAW_SQL}), x AS (SELECT row_id, manip_raw AS m, gt_origin AS g, {I._sql_list(LABELS)}[1 + group_no % 3] AS o, {I._sql_list(MLABELS)}[1 + row_id % 4] AS l, hint_raw AS h FROM r),
i AS (SELECT row_id, unnest(list_filter([CASE WHEN m = 'partial_ai_insert' AND o <> 'mixed_or_partial_ai' THEN 'partial_origin' END, CASE WHEN m = 'partial_ai_insert' AND l <> 'edited_or_spliced' THEN 'partial_manipulation' END, CASE WHEN m IN ('human_replay', 'ai_replay') AND l <> 'replayed_or_re_recorded' THEN 'replay_manipulation' END,
 CASE WHEN (m = 'human_replay' AND o <> 'human_likely') OR (m = 'ai_replay' AND o <> 'ai_likely') THEN 'replay_origin' END, CASE WHEN m = 'mixer_processed' AND g = 'human' AND (o <> 'human_likely' OR l <> 'channel_processed') THEN 'human_mixer_labels' END, CASE WHEN m = 'mixer_processed' AND g = 'human' AND h = 'conversion' THEN 'human_mixer_attack_hint' END,
 CASE WHEN m = 'clean_direct' AND g IN ('human', 'ai') AND l <> 'clean_original' THEN 'clean_manipulation' END], lambda x: x IS NOT NULL)) AS issue FROM x) SELECT row_id, issue FROM i""")
def label_consistency(spark, sf):
    r = I.raw_labels(spark, sf).withColumn("o", I._pick(LABELS, "group_no")).withColumn("l", I._pick(MLABELS, "row_id"))
    m, g, o, lab = c("manip_raw"), c("gt_origin"), c("o"), c("l")
    partial, mixer = m == "partial_ai_insert", (m == "mixer_processed") & (g == "human")
    return issue_rows(r, {
        "partial_origin": partial & (o != "mixed_or_partial_ai"), "partial_manipulation": partial & (lab != "edited_or_spliced"),
        "replay_manipulation": m.isin("human_replay", "ai_replay") & (lab != "replayed_or_re_recorded"),
        "replay_origin": ((m == "human_replay") & (o != "human_likely")) | ((m == "ai_replay") & (o != "ai_likely")),
        "human_mixer_labels": mixer & ((o != "human_likely") | (lab != "channel_processed")), "human_mixer_attack_hint": mixer & (c("hint_raw") == "conversion"),
        "clean_manipulation": (m == "clean_direct") & g.isin("human", "ai") & (lab != "clean_original")}, ["row_id"])


@query("v4_collection_rules", f"""WITH f AS ({I.FILES_SQL}), x AS (SELECT *, 'g' || CAST(file_id % 700 AS VARCHAR) AS grp, file_category IN ('ai_fabricated', 'human_fabricated') AS fab FROM f), s AS (SELECT grp FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT file_id, issue FROM (SELECT file_id, unnest(list_filter([CASE WHEN duration_sec < 8 THEN 'duration_below_minimum' WHEN duration_sec < 20 THEN 'duration_below_recommended' END, CASE WHEN fab AND region_end IS NULL THEN 'fabricated_without_region' END, CASE WHEN fab AND region_start < 0 THEN 'negative_start' END, CASE WHEN fab AND region_start >= duration_sec THEN 'start_past_duration' END,
 CASE WHEN fab AND region_end > duration_sec THEN 'end_past_duration' END, CASE WHEN grp IN (SELECT grp FROM s) THEN 'group_in_several_splits' END], lambda x: x IS NOT NULL)) AS issue FROM x)""")
def collection_rules(spark, sf):
    f = I.files(spark, sf).withColumn("grp", F.concat(F.lit("g"), (c("file_id") % 700).cast("string")))
    several = X.spread_groups(f, "grp", "split").select("grp", F.lit(True).alias("_several"))
    j = join_ids(f, several, ["grp"], "left")
    fab, d = c("file_category").isin("ai_fabricated", "human_fabricated"), c("duration_sec")
    return issue_rows(j, {
        "duration_below_minimum": d < 8, "duration_below_recommended": (d >= 8) & (d < 20), "fabricated_without_region": fab & c("region_end").isNull(),
        "negative_start": fab & (c("region_start") < 0), "start_past_duration": fab & (c("region_start") >= d), "end_past_duration": fab & (c("region_end") > d),
        "group_in_several_splits": c("_several")}, ["file_id"])


@query("v5_group_leakage", f"{MAN} SELECT file_id, count(DISTINCT split) AS folds FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_leakage(spark, sf):
    return X.spread_groups(I.manifest(spark, sf), "file_id", "split")


@query("v7_timestamp_audit", f"""WITH f AS ({I.FILES_SQL}), x AS (SELECT speaker_id, CAST(region_start AS VARCHAR) AS fabricated_start_sec, CASE WHEN speaker_id % 3 <> 0 THEN CAST(region_end AS VARCHAR) END AS fabricated_end_sec, CASE WHEN speaker_id % 11 = 0 THEN 'inside' END AS true_segment_label FROM f),
b AS (SELECT speaker_id, count(fabricated_start_sec) > 0 AS a, count(fabricated_end_sec) > 0 AS e, count(true_segment_label) > 0 AS t FROM x GROUP BY 1)
SELECT speaker_id, concat_ws(';', CASE WHEN a THEN 'fabricated_start_sec' END, CASE WHEN e THEN 'fabricated_end_sec' END, CASE WHEN t THEN 'true_segment_label' END) AS timestamp_columns_found, (a AND e) OR t AS usable_for_supervised_segment_training,
 CASE WHEN (a AND e) OR t THEN 'per-segment or start/end timestamp labels available' WHEN NOT a AND NOT e THEN 'only inherited file-level partial label available' ELSE 'timestamp labels incomplete' END AS reason FROM b""")
def timestamp_audit(spark, sf):
    f = I.files(spark, sf).select(
        "speaker_id", c("region_start").alias("fabricated_start_sec"), F.when(c("speaker_id") % 3 != 0, c("region_end")).alias("fabricated_end_sec"),
        F.when(c("speaker_id") % 11 == 0, "inside").alias("true_segment_label"))
    return Q.timestamp_audit(f, "speaker_id", [("fabricated_start_sec", "fabricated_end_sec")], ["true_segment_label"])


@query("v8_annotation_status", f"""WITH r AS ({I.RAW_SQL}), n AS (SELECT row_id, TRY_CAST(trim(number_raw) AS DOUBLE) AS s0, p1 * 3 AS e, lower(trim(coalesce(hint_raw, ''))) AS t FROM r), x AS (SELECT row_id, CASE WHEN isfinite(s0) THEN s0 END AS s, e, t FROM n)
SELECT row_id, round(CASE WHEN e > s THEN e - s END, 6) AS fabricated_duration_sec, CASE WHEN t IN ('conversion', 'fake') THEN 'positive' WHEN t = 'bonafide' THEN 'negative' WHEN t = '' THEN 'unknown' ELSE t END AS annotation_label,
 CASE WHEN s IS NULL THEN 'missing_start_or_end' WHEN e <= s THEN 'invalid_time_range' ELSE 'matched' END AS annotation_status FROM x""")
def annotation_status(spark, sf):
    r = I.raw_labels(spark, sf).withColumn("end_raw", (c("p1") * 3).cast("string"))
    out = Q.normalise_annotations(r, "number_raw", "end_raw", "hint_raw", ["conversion", "fake"], ["bonafide"])
    return rounded(out.select("row_id", "fabricated_duration_sec", "annotation_label", "annotation_status"))


@query("v9_rank_integrity", f"""WITH g AS ({I.SEGMENTS_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_sec, segment_id) - 1 + CASE WHEN file_id % 19 = 0 THEN 1 ELSE 0 END AS idx, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id) * CASE WHEN file_id % 23 = 0 THEN 2 ELSE 1 END AS rk FROM g),
a AS (SELECT file_id, count(*) AS n, min(rk) AS lo, max(rk) AS hi, count(DISTINCT rk) AS d, max(prob) AS top, max(prob) FILTER (rk = 1) AS fst, bool_or(idx <> pos) AS moved FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_sec, idx) - 1 AS pos FROM k) GROUP BY 1)
SELECT file_id, 'ranks_not_1_to_n' AS issue FROM a WHERE lo <> 1 OR hi <> n OR d <> n UNION ALL SELECT file_id, 'rank_1_not_maximum' FROM a WHERE fst IS NULL OR abs(fst - top) > 1e-9 UNION ALL SELECT file_id, 'index_not_chronological' FROM a WHERE moved""")
def rank_integrity(spark, sf):
    k = c("file_id")
    t = numbered(I.segments(spark, sf), ["file_id"], ["start_sec", "segment_id"], "_t")
    t = numbered(t, ["file_id"], [c("prob").desc(), "start_sec", "segment_id"], "_r")
    t = t.withColumn("idx", c("_t") - 1 + F.when(k % 19 == 0, 1).otherwise(0)).withColumn("rk", c("_r") * F.when(k % 23 == 0, 2).otherwise(1))
    return Q.rank_integrity(t, "file_id", "rk", "prob", "idx", "start_sec")


@query("v9_candidate_check", f"""WITH g AS ({I.SEGMENTS_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id) AS rk FROM g) SELECT o_orderkey AS file_id, CASE WHEN k.file_id IS NULL THEN 'no_rank_1' ELSE 'candidate_differs' END AS issue FROM orders LEFT JOIN k ON k.file_id = o_orderkey AND rk = 1 WHERE k.file_id IS NULL OR o_orderkey % 31 = 0""")
def candidate_check(spark, sf):
    t = numbered(I.segments(spark, sf), ["file_id"], [c("prob").desc(), "start_sec", "segment_id"], "segment_rank")
    seg = t.select("file_id", "segment_rank", c("start_sec").alias("segment_start"), c("end_sec").alias("segment_end"), c("prob").alias("segment_probability"))
    top = seg.where(c("segment_rank") == 1).select("file_id", "segment_start", "segment_end", "segment_probability")
    files = join_ids(I.files(spark, sf).select("file_id"), top, ["file_id"], "left").select(
        "file_id", (c("segment_start") + F.when(c("file_id") % 31 == 0, 1).otherwise(0)).alias("candidate_start"),
        c("segment_end").alias("candidate_end"), c("segment_probability").alias("candidate_probability"))
    return Q.candidate_matches_first(files, seg, "file_id")


@query("v10_fold_integrity", f"WITH p AS ({I.PREDICTIONS_SQL}) SELECT file_id, count(DISTINCT task_name) AS folds FROM p GROUP BY 1 HAVING count(DISTINCT task_name) > 1")
def fold_integrity(spark, sf):
    return X.spread_groups(I.predictions(spark, sf), "file_id", "task_name")


@query("v11_split_leakage", f"""{MAN}, k AS (SELECT speaker_id, max(split = 'train') AS tr, max(split = 'val') AS va, max(split = 'test') AS te FROM (SELECT 'g' || CAST(doc_id % 97 AS VARCHAR) AS speaker_id, split FROM m) GROUP BY 1)
SELECT split_a, split_b, n AS overlap_count, CASE WHEN n > 0 THEN 'high' ELSE 'none' END AS severity FROM (SELECT 'train' AS split_a, 'val' AS split_b, count(*) FILTER (tr AND va) AS n FROM k UNION ALL SELECT 'train', 'test', count(*) FILTER (tr AND te) FROM k UNION ALL SELECT 'val', 'test', count(*) FILTER (va AND te) FROM k)""")
def split_leakage(spark, sf):
    m = I.manifest(spark, sf).withColumn("g", F.concat(F.lit("g"), (c("doc_id") % 97).cast("string")))
    return J.split_overlap(m, "g", "split", ["train", "val", "test"]).drop("shared_key").distinct()


# Samples and splits ------------------------------------------------------------------------

MODES = "x AS (SELECT speaker_id, arg_min(dataset, (-n, dataset)) AS dataset FROM (SELECT speaker_id, dataset, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1), y AS (SELECT speaker_id, arg_min(label, (-n, label)) AS label FROM (SELECT speaker_id, label, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1)"


@query("x1_speaker_split", f"""{MAN}, {MODES.replace('arg_min(dataset, (-n, dataset))', "min(lpad(CAST(1000000000 - n AS VARCHAR), 12, '0') || dataset)").replace('arg_min(label, (-n, label))', "min(lpad(CAST(1000000000 - n AS VARCHAR), 12, '0') || label)")},
s AS (SELECT speaker_id, substr(dataset, 13) || '_' || substr(label, 13) AS stratum FROM x JOIN y USING (speaker_id)), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(speaker_id || ':42'), speaker_id) AS p, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT speaker_id, stratum, CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def speaker_split(spark, sf):
    return X.speaker_split(I.manifest(spark, sf), "speaker_id", ["dataset", "label"], 42)


@query("x2_split_verification", f"""{MAN}, p AS (SELECT split, speaker_id, count(*) AS n, count(*) FILTER (label = 'bonafide') AS r, count(*) FILTER (label = 'spoof') AS k, bool_or(dataset = 'RealWorld') AS rw, bool_or(dataset <> 'RealWorld') AS be FROM m GROUP BY ALL), s AS (SELECT *, count(*) OVER (PARTITION BY speaker_id) AS c FROM p)
SELECT split, CAST(sum(n) AS BIGINT) AS rows, count(*) AS speakers, count(*) FILTER (c > 1) AS shared_speakers, sum(r) > 0 AND sum(k) > 0 AS both_classes, bool_or(rw) AND bool_or(be) AS both_sources, round(sum(r) / sum(n), 6) AS real_ratio FROM s GROUP BY 1""")
def split_verification(spark, sf):
    return rounded(X.verify_splits(I.manifest(spark, sf), "speaker_id", "split", "label", c("dataset") == "RealWorld"))


@query("x3_sample_per_group", f"{MAN} SELECT attack_type, doc_id FROM m QUALIFY row_number() OVER (PARTITION BY attack_type ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) <= 40")
def sample_per_group(spark, sf):
    return X.sample_per_group(I.manifest(spark, sf).select("attack_type", "doc_id"), ["attack_type"], "doc_id", 40, 7)


@query("x3_shortfalls", f"{MAN} SELECT dataset, domain, count(*) AS available, 70 AS requested FROM m GROUP BY ALL HAVING count(*) < 70")
def shortfalls(spark, sf):
    return X.shortfalls(I.manifest(spark, sf), ["dataset", "domain"], 70)


@query("x4_stratified_sample", f"""{MAN}, k AS (SELECT doc_id, dataset, label, md5(CAST(doc_id AS VARCHAR) || ':11') AS h, row_number() OVER (PARTITION BY dataset, label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':11'), doc_id) AS r FROM m)
SELECT doc_id, dataset, label, r <= 5 AS from_stratum FROM k ORDER BY r > 5, h, doc_id LIMIT 180""")
def stratified_sample(spark, sf):
    return X.stratified_sample(I.manifest(spark, sf).select("doc_id", "dataset", "label"), ["dataset", "label"], "doc_id", 180, 11)


NEG = f"""{SEG}, s AS (SELECT segment_id, g.file_id, y_true, CASE WHEN file_category IN ('ai_fabricated', 'human_fabricated') THEN 'outside' ELSE file_category END AS kind FROM g JOIN f USING (file_id)), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(file_id AS VARCHAR) || '/' || segment_id || ':5'), CAST(file_id AS VARCHAR) || '/' || segment_id) AS r FROM s WHERE y_true = 0)"""


@query("x5_negative_sampling", f"{NEG} SELECT file_id, segment_id, y_true, kind FROM s WHERE y_true = 1 UNION ALL SELECT file_id, segment_id, y_true, kind FROM k WHERE r <= 500")
def negative_sampling(spark, sf):
    f = I.files(spark, sf).select("file_id", F.when(c("file_category").isin("ai_fabricated", "human_fabricated"), "outside").otherwise(c("file_category")).alias("kind"))
    s = join_ids(I.segments(spark, sf).select("file_id", "segment_id", "y_true"), f, ["file_id"]).withColumn("key", F.concat_ws("/", c("file_id").cast("string"), "segment_id"))
    return X.downsample_negatives(s, "y_true", "kind", "key", 500, 5).drop("key")


@query("x6_cap_per_category", f"WITH f AS ({I.FILES_SQL}) SELECT file_category, file_id FROM f QUALIFY row_number() OVER (PARTITION BY file_category ORDER BY md5(CAST(file_id AS VARCHAR) || ':3'), file_id) <= 25")
def cap_per_category(spark, sf):
    return X.sample_per_group(I.files(spark, sf).select("file_category", "file_id"), ["file_category"], "file_id", 25, 3)


FOLD = f"""WITH p AS ({I.PREDICTIONS_SQL}), x AS (SELECT file_id, avg(y_true) AS mm FROM p GROUP BY 1), l AS (SELECT file_id, CASE WHEN mm = 0 THEN 0 WHEN mm < 0.5 THEN 1 WHEN mm < 1 THEN 2 ELSE 3 END AS class_mix FROM x),
fo AS (SELECT file_id, class_mix, CAST((row_number() OVER (PARTITION BY class_mix ORDER BY md5(CAST(file_id AS VARCHAR) || ':42'), file_id) - 1 + class_mix) % 5 AS INTEGER) AS fold FROM l)"""


@query("x7_group_folds", f"{FOLD} SELECT file_id, class_mix, fold FROM fo")
def group_folds(spark, sf):
    return X.group_folds(I.predictions(spark, sf), "file_id", "y_true", 5, 42)


@query("x8_fold_groups", f"{FOLD} SELECT fold, count(DISTINCT p.file_id) AS groups, count(*) AS rows, round(avg(y_true), 6) AS positive_rate, 0::BIGINT AS groups_in_other_folds FROM p JOIN fo USING (file_id) GROUP BY 1")
def fold_groups(spark, sf):
    p = I.predictions(spark, sf)
    files = p.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("p"))  # rows of a file need no fold of their own
    j = settled(join_ids(files, X.group_folds(p, "file_id", "y_true", 5, 42), ["file_id"]))
    split = X.spread_groups(j, "file_id", "fold").select("file_id", F.lit(1).alias("_bad"))
    per = join_ids(j.groupBy("fold", "file_id").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), split, ["file_id"], "left")
    return rounded(per.groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), (F.sum("p") / F.sum("n")).alias("positive_rate"),
                                           F.count("_bad").alias("groups_in_other_folds")))


@query("x9_split_of_base", f"WITH f AS ({I.FILES_SQL}), x AS (SELECT file_id, CAST(speaker_id % 26 AS INTEGER) AS n FROM f) SELECT file_id, CASE WHEN n BETWEEN 1 AND 16 THEN 'train' WHEN n BETWEEN 17 AND 19 THEN 'val' WHEN n BETWEEN 20 AND 23 THEN 'test' ELSE 'unassigned' END AS split FROM x")
def split_of_base(spark, sf):
    return I.files(spark, sf).select("file_id", L.split_of_base((c("speaker_id") % 26).cast("int")).alias("split"))


# Features and models -----------------------------------------------------------------------


@query("m4_pooled_vectors", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT label, d, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY ALL)
SELECT label, CAST(d - 1 AS INTEGER) AS position, round(m, 6) AS value FROM s UNION ALL SELECT label, CAST(63 + d AS INTEGER), round(s, 6) FROM s""")
def pooled_vectors(spark, sf):
    p = E.pooled_vectors(I.table(spark, sf, "embeddings"), ["label"], "embedding")
    return rounded(p.select("label", F.posexplode("pooled").alias("position", "value")))


def model_rows(spark, sf):
    return I.segments(spark, sf).select("file_id", "segment_id", *I.FEATURES, "prob", (c("f_discount") + c("f_quantity") / 1000 > 0.07).cast("int").alias("label"))


def fitted_sql(rows: str, masks: list[str], k: int, steps: int = N.STEPS, ridge: float = N.RIDGE) -> str:
    """Table expressions that do what `newton.fit` does: `rows` is SQL with (id, y, features), `masks` conditions over it.

    Ends with `scored` (id, model, p): the chance of every row under every model.
    """
    d = range(k + 1)
    z = lambda i: "1.0::DOUBLE" if i == 0 else f"z{i}"
    line = " + ".join(f"b{i} * {z(i)}" for i in d)
    out = [f"""r AS MATERIALIZED ({rows}),
t AS MATERIALIZED (SELECT id, y, model, feature, place, x, train FROM (SELECT id, y, unnest({I.FEATURES}) AS feature, unnest(range({len(I.FEATURES)})) AS place,
   unnest([{', '.join(f'{f}::DOUBLE' for f in I.FEATURES)}]) AS x, [{', '.join(masks)}] AS trains FROM r), LATERAL (SELECT unnest(range({len(masks)})) AS model, unnest(trains) AS train)),
med AS (SELECT model, feature, quantile_cont(x, 0.5) FILTER (train) AS md FROM t GROUP BY ALL),
cls AS (SELECT model, feature, place, y, count(*) AS n, avg(coalesce(x, md)) AS a, coalesce(var_samp(coalesce(x, md)), 0) AS s FROM t JOIN med USING (model, feature) WHERE train GROUP BY ALL),
tot AS (SELECT model, feature, place, sum(n) AS n, sum(n * a) / sum(n) AS mean, sum((n - 1) * s) AS within FROM cls GROUP BY ALL),
rated AS (SELECT t.model, t.feature, t.place, t.n, t.mean, t.within, sum(c.n * (c.a - t.mean) * (c.a - t.mean)) AS between_ FROM tot t JOIN cls c USING (model, feature) GROUP BY ALL),
best AS (SELECT *, sqrt((within + between_) / (n - 1)) AS dev, row_number() OVER (PARTITION BY model ORDER BY between_ / (within / (n - 2)) DESC, place) AS rank FROM rated QUALIFY rank <= {k}),
cw AS (SELECT model, n / (2 * n1) AS w1, n / (2 * n0) AS w0, n FROM (SELECT model, sum(n) AS n, sum(n) FILTER (y = 1) AS n1, sum(n) FILTER (y = 0) AS n0 FROM cls WHERE place = 0 GROUP BY 1)),
d AS MATERIALIZED (SELECT t.id, t.model, any_value(t.y) AS y, any_value(t.train) AS train, {', '.join(f'max((coalesce(t.x, m.md) - b.mean) / b.dev) FILTER (b.rank = {i}) AS z{i}' for i in d[1:])}
   FROM t JOIN best b USING (model, feature) JOIN med m USING (model, feature) GROUP BY t.id, t.model),
w0 AS MATERIALIZED (SELECT model, {', '.join(f'0::DOUBLE AS b{i}' for i in d)} FROM cw)"""]
    for s in range(steps):
        grad = ", ".join(f"sum(w * (p - y) * {z(i)}) / any_value(n) + {ridge if i else 0} * any_value(b{i}) AS c0_{i}" for i in d)
        bend = ", ".join(f"sum(w * p * (1 - p) * {z(i)} * {z(j)}) / any_value(n) + {ridge if i == j and i else 0} AS a0_{i}_{j}" for i in d for j in d)
        out.append(f"""e{s} AS MATERIALIZED (SELECT model, {', '.join(f'any_value(b{i}) AS b{i}' for i in d)}, {grad}, {bend} FROM (
   SELECT d.*, cw.n, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w, {', '.join(f'b{i}' for i in d)}, 1 / (1 + exp(-({line}))) AS p
   FROM d JOIN cw USING (model) JOIN w{s} USING (model) WHERE train) GROUP BY model)""")
        solve = []  # elimination column by column, then the weights from the last to the first
        for q in range(k):
            for i in range(q + 1, k + 1):
                solve += [f"a{q}_{i}_{j} - a{q}_{i}_{q} / a{q}_{q}_{q} * a{q}_{q}_{j} AS a{q + 1}_{i}_{j}" for j in range(q + 1, k + 1)]
                solve.append(f"c{q}_{i} - a{q}_{i}_{q} / a{q}_{q}_{q} * c{q}_{q} AS c{q + 1}_{i}")
        for i in reversed(d):
            rest = "".join(f" - a{i}_{i}_{j} * u{j}" for j in range(i + 1, k + 1))
            solve.append(f"(c{i}_{i}{rest}) / a{i}_{i}_{i} AS u{i}")
        out.append(f"""w{s + 1} AS MATERIALIZED (SELECT model, {', '.join(f'b{i} - u{i} AS b{i}' for i in d)} FROM (SELECT *, {', '.join(solve)} FROM e{s}))""")
    out.append(f"scored AS (SELECT id, model, 1 / (1 + exp(-({line}))) AS p FROM d JOIN w{steps} USING (model))")
    return ",\n".join(out)


MODEL_ROWS = f"""SELECT row_number() OVER () AS id, file_id, segment_id, {', '.join(I.FEATURES)}, CASE WHEN f_discount + f_quantity / 1000 > 0.07::DOUBLE THEN 1 ELSE 0 END AS y FROM ({I.SEGMENTS_SQL})"""


@query("m5_pipeline_scores", f"""WITH {fitted_sql(MODEL_ROWS, ['file_id % 4 <> 0'], 2)}
SELECT file_id, segment_id, y AS label, round(p, 6) AS probability, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction_at_threshold
FROM r JOIN scored USING (id) WHERE file_id % 4 = 0""")
def pipeline_scores(spark, sf):
    rows = model_rows(spark, sf)
    model = N.fit(rows, I.FEATURES, "label", {"train": c("file_id") % 4 != 0}, 2)["train"]
    return rounded(N.score(model, rows.where(c("file_id") % 4 == 0), ["file_id", "segment_id", "label"], 0.5))


@query("m6_anova_f", """WITH l AS (SELECT unnest(['f_quantity', 'f_price', 'f_discount', 'f_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x, l_returnflag AS y FROM lineitem), g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY ALL),
t AS (SELECT feature, avg(x) AS gm, count(*) AS nn FROM l GROUP BY 1) SELECT feature, round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * v) / (max(nn) - count(*))), 6) AS f_value FROM g JOIN t USING (feature) GROUP BY feature""")
def anova_f(spark, sf):
    li = I.segments(spark, sf).select(*I.FEATURES)
    flags = I.table(spark, sf, "lineitem").select(c("l_returnflag").alias("y"), c("l_quantity").alias("f_quantity"), c("l_extendedprice").alias("f_price"),
                                                  c("l_discount").alias("f_discount"), c("l_tax").alias("f_tax"))
    return rounded(ML.anova_f(feature_long(flags, li.columns, ["y"]), "y"))


OOF = f"""WITH base AS ({MODEL_ROWS}), x AS (SELECT file_id, avg(y) AS mm FROM base GROUP BY 1), l AS (SELECT file_id, CASE WHEN mm = 0 THEN 0 WHEN mm < 0.5 THEN 1 WHEN mm < 1 THEN 2 ELSE 3 END AS class_mix FROM x),
fo AS (SELECT file_id, CAST((row_number() OVER (PARTITION BY class_mix ORDER BY md5(CAST(file_id AS VARCHAR) || ':42'), file_id) - 1 + class_mix) % 3 AS INTEGER) AS fold FROM l),
{fitted_sql('SELECT base.*, fold FROM base JOIN fo USING (file_id)', ['fold <> 0', 'fold <> 1', 'fold <> 2'], 2)},
oof AS (SELECT file_id, segment_id, y, fold, p AS raw, round(p, 9) AS prob FROM r JOIN scored s ON r.id = s.id AND r.fold = s.model)"""


def held_out(spark, sf):
    return N.out_of_fold(model_rows(spark, sf), I.FEATURES, "label", "file_id", ["file_id", "segment_id", "label"], 3, 2, 42)


@query("m7_out_of_fold", f"""{OOF} SELECT file_id, segment_id, y AS label, fold, round(raw, 6) AS probability,
  CASE WHEN raw >= 0.5 THEN 1 ELSE 0 END AS prediction_at_threshold FROM oof""")
def out_of_fold(spark, sf):
    return rounded(held_out(spark, sf))


@query("m7_fold_metrics", f"""{OOF}, st AS (SELECT fold, prob AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM oof GROUP BY ALL),
steps AS (SELECT *, sum(pos) OVER w AS tp_, sum(neg) OVER w AS fp_, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS q FROM st WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT fold, sum(neg * (tp_ - pos + pos / 2)) / (max(p) * CAST(max(q) AS DOUBLE)) AS roc_auc, sum(pos * (tp_ / (tp_ + fp_))) / max(p) AS average_precision,
   sum(neg) FILTER (score < 0.5) AS tn, sum(neg) FILTER (score >= 0.5) AS fp, sum(pos) FILTER (score < 0.5) AS fn, sum(pos) FILTER (score >= 0.5) AS tp,
   sum(pos * (score - 1) * (score - 1) + neg * score * score) / sum(pos + neg) AS brier_score FROM steps GROUP BY fold),
e AS (SELECT CAST(fold AS VARCHAR) AS fold, tn, fp, fn, tp, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
   tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tn / (tn + fp) AS specificity, roc_auc, average_precision, brier_score FROM k),
a AS (SELECT * FROM e UNION ALL SELECT 'mean', sum(tn), sum(fp), sum(fn), sum(tp), avg(accuracy), avg(balanced_accuracy), avg(precision), avg(recall), avg(f1), avg(specificity), avg(roc_auc), avg(average_precision), avg(brier_score) FROM e)
SELECT fold, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, {', '.join(f'round({n}, 6) AS {n}' for n in (
    'accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1', 'specificity', 'roc_auc', 'average_precision', 'brier_score'))} FROM a""")
def fold_metrics(spark, sf):
    return rounded(N.fold_metrics(held_out(spark, sf).withColumn("probability", F.round("probability", 9)), "label", "probability"))


@query("m8_batch_scores", f"""WITH {fitted_sql(MODEL_ROWS, ['true'], 3)}
SELECT CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS prediction_at_threshold, count(*) AS n, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS positive_rate
FROM r JOIN scored USING (id) GROUP BY 1""")
def batch_scores(spark, sf):
    rows = model_rows(spark, sf)
    s = N.score(N.fit(rows, I.FEATURES, "label", {"all": F.lit(True)}, 3)["all"], rows, ["file_id", "label"], 0.6)
    return rounded(s.groupBy("prediction_at_threshold").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg("label").alias("positive_rate")))


@query("m9_nearest_group", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS p, l_quantity AS q, l_tax AS t, l_returnflag || l_linestatus AS g FROM lineitem), st AS (SELECT median(p) AS mp, median(q) AS mq, median(t) AS mt, stddev_samp(p) AS sp, stddev_samp(q) AS sq, stddev_samp(t) AS stt FROM s),
z AS (SELECT s.*, (p - mp) / sp AS zp, (q - mq) / sq AS zq, (t - mt) / stt AS zt FROM s, st), c AS (SELECT g AS cg, avg(zp) AS cp, avg(zq) AS cq, avg(zt) AS ct FROM z GROUP BY 1),
d AS (SELECT z.g, cg, sqrt(((zp - cp) * (zp - cp) + (zq - cq) * (zq - cq) + (zt - ct) * (zt - ct)) / 3) AS dist, z.l_orderkey, z.l_linenumber, z.l_partkey, z.l_suppkey, z.p FROM z, c), m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p ORDER BY dist, cg) = 1)
SELECT g AS group_name, round(avg(dist), 6) AS mean_nearest_distance, count(*) AS n FROM m GROUP BY 1""")
def nearest_group(spark, sf):
    li = I.table(spark, sf, "lineitem").select(
        F.concat_ws("/", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("group_name"),
        c("l_extendedprice").alias("p"), c("l_quantity").alias("q"), c("l_tax").alias("t"))
    d = ML.centroid_distances(li, "id", "group_name", ["p", "q", "t"])
    return d.groupBy("group_name").agg(F.round(F.avg("nearest_distance"), 6).alias("mean_nearest_distance"), F.count(F.lit(1)).alias("n"))


@query("m9_group_gaps", """WITH s AS (SELECT l_extendedprice AS p, l_quantity AS q, l_tax AS t, l_returnflag AS g FROM lineitem), st AS (SELECT median(p) AS mp, median(q) AS mq, median(t) AS mt, stddev_samp(p) AS sp, stddev_samp(q) AS sq, stddev_samp(t) AS stt FROM s)
SELECT g AS group_name, unnest(['p', 'q', 't']) AS feature, unnest([round(avg((p - mp) / sp), 6), round(avg((q - mq) / sq), 6), round(avg((t - mt) / stt), 6)]) AS mean_z FROM s, st GROUP BY g""")
def group_gaps(spark, sf):
    li = I.table(spark, sf, "lineitem").select(c("l_returnflag").alias("group_name"), c("l_extendedprice").alias("p"), c("l_quantity").alias("q"), c("l_tax").alias("t"))
    return rounded(ML.group_gaps(li, "group_name", ["p", "q", "t"]))
