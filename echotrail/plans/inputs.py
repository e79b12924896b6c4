"""The input tables in the roles of recordings, segments, predictions and timelines.

Each adapter has a SQL twin (`*_SQL`) made of the same deterministic expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Segments: one line of an order is one segment of a recording -------------------------

SEGMENTS_SQL = """
SELECT l_orderkey AS file_id,
       lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '_' || CAST(l_partkey AS VARCHAR) || '_' ||
         CAST(l_suppkey AS VARCHAR) || '_' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS segment_id,
       (l_linenumber - 1) * CAST(2.0 AS DOUBLE) AS start_sec,
       (l_linenumber - 1) * CAST(2.0 AS DOUBLE) + CAST(4.0 AS DOUBLE) AS end_sec,
       l_quantity AS f_quantity, l_extendedprice AS f_price, l_discount AS f_discount, l_tax AS f_tax,
       (l_quantity / 50 + l_discount * 10) / 2 AS prob,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true
FROM lineitem
"""

FEATURES = ["f_quantity", "f_price", "f_discount", "f_tax"]


def segments(spark: SparkSession, folder: str) -> DataFrame:
    start = (F.col("l_linenumber") - 1) * F.lit(2.0)
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.concat_ws("_", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
                    "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("long")).alias("segment_id"),
        start.alias("start_sec"),
        (start + F.lit(4.0)).alias("end_sec"),
        F.col("l_quantity").alias("f_quantity"),
        F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_discount"),
        F.col("l_tax").alias("f_tax"),
        ((F.col("l_quantity") / 50 + F.col("l_discount") * 10) / 2).alias("prob"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
    )


# Recordings: one order is one recording ----------------------------------------------

FILES_SQL = """
SELECT o_orderkey AS file_id,
       '/data/raw/' || lower(o_orderpriority) || '/clip_' || CAST(o_orderkey AS VARCHAR) || '.wav' AS audio_path,
       o_custkey AS speaker_id,
       o_orderstatus AS dataset,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'human_fabricated' WHEN '2' THEN 'ai_fabricated'
            WHEN '3' THEN 'ai_direct' WHEN '4' THEN 'ai_replay' ELSE 'ai_mixer' END AS file_category,
       CASE WHEN o_totalprice / 500000 < 1 THEN o_totalprice / 500000 ELSE CAST(1 AS DOUBLE) END AS gate_prob,
       4 + (o_orderkey % 13) * CAST(1.5 AS DOUBLE) AS duration_sec,
       CASE WHEN o_custkey % 10 = 8 THEN 'val' WHEN o_custkey % 10 = 9 THEN 'test' ELSE 'train' END AS split,
       CASE WHEN o_orderpriority < '3' AND o_orderkey % 4 <> 0 THEN (o_orderkey % 5) * CAST(1.0 AS DOUBLE) END AS region_start,
       CASE WHEN o_orderpriority < '3' AND o_orderkey % 4 <> 0
            THEN (o_orderkey % 5) * CAST(1.0 AS DOUBLE) + 3 + (o_orderkey % 3) END AS region_end
FROM orders
"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    prio = F.col("o_orderpriority")
    key = F.col("o_orderkey")
    lead = F.substring(prio, 1, 1)
    has_region = (prio < "3") & (key % 4 != 0)
    begin = (key % 5) * F.lit(1.0)
    bucket = F.col("o_custkey") % 10
    return table(spark, folder, "orders").select(
        key.alias("file_id"),
        F.concat(F.lit("/data/raw/"), F.lower(prio), F.lit("/clip_"),
                 key.cast("string"), F.lit(".wav")).alias("audio_path"),
        F.col("o_custkey").alias("speaker_id"),
        F.col("o_orderstatus").alias("dataset"),
        F.when(lead == "1", "human_fabricated").when(lead == "2", "ai_fabricated")
        .when(lead == "3", "ai_direct").when(lead == "4", "ai_replay")
        .otherwise("ai_mixer").alias("file_category"),
        F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("gate_prob"),
        (4 + (key % 13) * F.lit(1.5)).alias("duration_sec"),
        F.when(bucket == 8, "val").when(bucket == 9, "test").otherwise("train").alias("split"),
        F.when(has_region, begin).alias("region_start"),
        F.when(has_region, begin + 3 + key % 3).alias("region_end"),
    )


# Held-out predictions: one line is one scored row of a task ----------------------------

PREDICTIONS_SQL = """
SELECT l_orderkey AS file_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'origin_file_model' WHEN 1 THEN 'replay_file_model'
            ELSE 'mixer_file_model' END AS task_name,
       CASE WHEN l_linestatus = 'F' THEN 'ssl' ELSE 'acoustic' END AS feature_set,
       CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS y_true,
       (l_quantity / 50 + l_discount * 10) / 2 AS prob
FROM lineitem
"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    slot = F.col("l_suppkey") % 3
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.when(slot == 0, "origin_file_model").when(slot == 1, "replay_file_model")
        .otherwise("mixer_file_model").alias("task_name"),
        F.when(F.col("l_linestatus") == "F", "ssl").otherwise("acoustic").alias("feature_set"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("y_true"),
        ((F.col("l_quantity") / 50 + F.col("l_discount") * 10) / 2).alias("prob"),
    )


# Chunk timelines: one event is one scored chunk of a sample ----------------------------

TIMELINE_SQL = """
SELECT user_id AS sample_id, event_id AS chunk_id,
       epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00') / CAST(1000000 AS DOUBLE) AS start_time,
       epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00') / CAST(1000000 AS DOUBLE)
         + 3600 * (1 + event_id % 12) AS end_time,
       CASE WHEN value / 60 < 1 THEN value / 60 ELSE CAST(1 AS DOUBLE) END AS spoof_probability,
       event_id % 17 <> 0 AS evaluated,
       event_type AS attack_type,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE
         '[' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) || ','
             || CAST(event_id % 89 AS VARCHAR) || ',' || CAST(event_id % 97 AS VARCHAR) || ','
             || CAST(event_id % 83 AS VARCHAR) || ']' END AS attack_probs,
       (user_id % 7) * CAST(86400 AS DOUBLE) AS region_start,
       (user_id % 7) * CAST(86400 AS DOUBLE) + 432000 AS region_end
FROM events
"""


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    start = F.expr(
        "CAST(CAST(CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'2024-01-01 00:00:00' "
        "AS INTERVAL SECOND) AS DECIMAL(20,6))").cast("double")
    return table(spark, folder, "events").select(
        uid.alias("sample_id"), eid.alias("chunk_id"),
        start.alias("start_time"),
        (start + 3600 * (1 + eid % 12)).alias("end_time"),
        F.least(F.col("value") / 60, F.lit(1.0)).alias("spoof_probability"),
        (eid % 17 != 0).alias("evaluated"),
        F.col("event_type").alias("attack_type"),
        F.when(eid % 5 != 0, F.concat(
            F.lit("["), F.get_json_object("props", "$.k"), F.lit(","),
            (eid % 89).cast("string"), F.lit(","), (eid % 97).cast("string"), F.lit(","),
            (eid % 83).cast("string"), F.lit("]"))).alias("attack_probs"),
        ((uid % 7) * F.lit(86400.0)).alias("region_start"),
        ((uid % 7) * F.lit(86400.0) + 432000).alias("region_end"),
    )


# Manifest: one document is one row of a recording manifest -----------------------------

MANIFEST_SQL = """
SELECT doc_id, '/corpus/' || source || '/' || lang || '/item_' || CAST(doc_id % 900 AS VARCHAR) || '.wav' AS filepath,
       'item_' || CAST(doc_id % 900 AS VARCHAR) AS file_id,
       CASE WHEN doc_id % 3 = 0 THEN 'bonafide' WHEN doc_id % 41 = 1 THEN '' ELSE 'spoof' END AS label,
       CASE WHEN doc_id % 29 = 0 THEN 'synthesis' WHEN doc_id % 3 = 0 THEN 'bonafide' WHEN doc_id % 31 = 2 THEN NULL
            WHEN doc_id % 4 = 1 THEN 'synthesis' WHEN doc_id % 4 = 2 THEN 'conversion' WHEN doc_id % 4 = 3 THEN 'replay'
            ELSE 'bonafide' END AS attack_type,
       CASE doc_id % 4 WHEN 0 THEN 'LA' WHEN 1 THEN 'DF' WHEN 2 THEN 'PA' ELSE 'RealWorld' END AS dataset,
       CASE lang WHEN 'en' THEN 'studio' WHEN 'fr' THEN 'podcast' WHEN 'de' THEN 'phone' ELSE 'attic' END AS domain,
       source, 'spk_' || CAST(doc_id % 211 AS VARCHAR) AS speaker_id,
       CASE WHEN doc_id % 37 = 0 THEN NULL ELSE n_chars / CAST(100 AS DOUBLE) END AS duration,
       CASE WHEN doc_id % 211 % 10 = 8 THEN 'val' WHEN doc_id % 211 % 10 = 9 THEN 'test' ELSE 'train' END AS split
FROM documents
"""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    item = (d % 900).cast("string")
    spk = d % 211
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/item_"), item,
                 F.lit(".wav")).alias("filepath"),
        F.concat(F.lit("item_"), item).alias("file_id"),
        F.when(d % 3 == 0, "bonafide").when(d % 41 == 1, "").otherwise("spoof").alias("label"),
        F.when(d % 29 == 0, "synthesis").when(d % 3 == 0, "bonafide")
        .when(d % 31 == 2, F.lit(None).cast("string"))
        .when(d % 4 == 1, "synthesis").when(d % 4 == 2, "conversion").when(d % 4 == 3, "replay")
        .otherwise("bonafide").alias("attack_type"),
        F.when(d % 4 == 0, "LA").when(d % 4 == 1, "DF").when(d % 4 == 2, "PA")
        .otherwise("RealWorld").alias("dataset"),
        F.when(F.col("lang") == "en", "studio").when(F.col("lang") == "fr", "podcast")
        .when(F.col("lang") == "de", "phone").otherwise("attic").alias("domain"),
        "source",
        F.concat(F.lit("spk_"), spk.cast("string")).alias("speaker_id"),
        F.when(d % 37 != 0, F.col("n_chars") / F.lit(100.0)).alias("duration"),
        F.when(spk % 10 == 8, "val").when(spk % 10 == 9, "test").otherwise("train").alias("split"),
    )


# Model results: one order is one evaluated sample, under three model variants ----------


def _variant_sql(mult: int) -> str:
    return f"""
SELECT o_orderkey AS sample_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'clean_direct' WHEN '2' THEN 'human_replay'
            WHEN '3' THEN 'ai_replay' WHEN '4' THEN 'mixer_processed' ELSE 'partial_ai_insert' END AS manipulation_type,
       CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'mixed' WHEN o_custkey % 2 = 0 THEN 'human' ELSE 'ai' END AS ground_truth_origin,
       (o_orderkey * {mult} % 101) / CAST(100 AS DOUBLE) AS decision_score,
       CASE WHEN (o_orderkey * {mult} % 101) / CAST(100 AS DOUBLE) >= 0.7 THEN 'FAKE' ELSE 'REAL' END AS prediction,
       (o_orderkey * {mult + 16} % 103) / CAST(100 AS DOUBLE) AS max_chunk_spoof,
       (o_orderkey * {mult + 30} % 61) / CAST(100 AS DOUBLE) AS suspicious_chunk_ratio,
       CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 5) * CAST(1.0 AS DOUBLE) END AS suspicious_start_time,
       CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 5) * CAST(1.0 AS DOUBLE) + o_orderkey % 3 END AS suspicious_end_time,
       o_orderkey * {mult} % 2 = 0 AND o_orderkey % 3 <> 1 AS partial_region_detected,
       CASE WHEN o_orderkey % 97 = 0 THEN 'decode error' END AS error
FROM orders
"""


VARIANTS = {"baseline": 37, "product": 41, "loss": 53}
RESULTS_SQL = {name: _variant_sql(mult) for name, mult in VARIANTS.items()}


def model_results(spark: SparkSession, folder: str, variant: str = "baseline") -> DataFrame:
    mult = VARIANTS[variant]
    key = F.col("o_orderkey")
    lead = F.substring("o_orderpriority", 1, 1)
    score = (key * mult % 101) / F.lit(100.0)
    begin = (key % 5) * F.lit(1.0)
    return table(spark, folder, "orders").select(
        key.alias("sample_id"),
        F.when(lead == "1", "clean_direct").when(lead == "2", "human_replay")
        .when(lead == "3", "ai_replay").when(lead == "4", "mixer_processed")
        .otherwise("partial_ai_insert").alias("manipulation_type"),
        F.when(lead == "5", "mixed").when(F.col("o_custkey") % 2 == 0, "human")
        .otherwise("ai").alias("ground_truth_origin"),
        score.alias("decision_score"),
        F.when(score >= 0.7, "FAKE").otherwise("REAL").alias("prediction"),
        ((key * (mult + 16) % 103) / F.lit(100.0)).alias("max_chunk_spoof"),
        ((key * (mult + 30) % 61) / F.lit(100.0)).alias("suspicious_chunk_ratio"),
        F.when(key % 4 != 0, begin).alias("suspicious_start_time"),
        F.when(key % 4 != 0, begin + key % 3).alias("suspicious_end_time"),
        ((key * mult % 2 == 0) & (key % 3 != 1)).alias("partial_region_detected"),
        F.when(key % 97 == 0, "decode error").alias("error"),
    )


def gap_results(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline results as they arrive: some scores missing, some predictions unknown, some partial flags set."""
    key = F.col("sample_id")
    return (model_results(spark, folder)
            .withColumn("prediction", F.when(key % 13 == 5, "n/a").when(key % 13 == 6, None).when(key % 13 == 7, " fake").otherwise(F.col("prediction")))
            .withColumn("decision_score", F.when(key % 3 != 1, F.col("decision_score")))
            .withColumn("partial_fabrication_binary", F.when(key % 17 == 0, "Yes").when(key % 17 == 1, "no").when(key % 17 == 2, "maybe")))


GAP_RESULTS_SQL = f"""SELECT * REPLACE (
    CASE WHEN sample_id % 13 = 5 THEN 'n/a' WHEN sample_id % 13 = 6 THEN NULL WHEN sample_id % 13 = 7 THEN ' fake' ELSE prediction END AS prediction,
    CASE WHEN sample_id % 3 <> 1 THEN decision_score END AS decision_score),
  CASE sample_id % 17 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' END AS partial_fabrication_binary
FROM ({RESULTS_SQL['baseline']})"""


# Raw label text: one order is one row of an unclean manifest ----------------------------

_ORIGINS = ["Human", " AI ", "spoof", "bonafide", "mixed", "weird", "", None, "na",
            "direct_synthetic", "ai_likely"]
_TOKENS_A = ["clean", "Replay", "mixer", "partial_ai_insert", "direct_synthetic", "foo", "", "edited",
             "clean_direct"]
_TOKENS_B = ["", "clean", "low_quality", "replayed", "unknown_manipulation", " spliced ", "na"]
_SEPARATORS = [";", "|", ",", ";;"]
_SPLITS = ["train", "Validation", "eval", "foo", None, " TEST "]
_NAMES = ["my_train_list", "Val set", "TEST_part", "misc", "asvspoof_2019"]
_NUMBERS = ["1.5", " 2 ", "", "abc", "NaN", "inf", None, "-3e2", "00:90", "01:02:03", "1:xx"]
_FLAGS = ["1", "TRUE", "yes", "y", "0", "False", "no", "n", "", "maybe", None]
_STEMS = ["tts_clip", "news_hour_001", "podcast_ep", "phone_call_spk12", "tiktok_social", "vctk_set",
          "librispeech_speaker7_x", "voxceleb1", "plain.v2", "replay_fake", "conversion_spoof",
          "synthesis_fake", "human_001_clean", "ai_7_replay_laptop_mobile", "human_0012_mixer_processed",
          "ai_003_fabricated", "human_5_direct", "bad_short_1", "ai_mixer", "human_fabricated_v2"]
_FOLDERS = ["raw/ai_direct", "RAW/human_repeat", "raw/other", "set\\ai_mixer", "human_replay", "x/raw/human_clean"]
_MANIPS = ["clean_direct", "human_replay", "ai_replay", "mixer_processed", "whatsapp_compressed",
           "youtube_broadcast", "phone_recorded", "edited_spliced", "partial_ai_insert", "noisy_room", "odd"]
_GT = ["human", "ai", "mixed", "unknown"]
_GT_MANIPS = ["clean", "", "replayed", "processed", "unknown"]
_STATUSES = ["clean_human_borderline", "direct_ai_detected", "direct_ai_missed", "unknown_review_required",
             "direct_ai_file_level_missed_but_segment_suspicious", "clean_human_false_alarm",
             "partial_fabrication_missed", "partial_not_evaluated_missing_timestamp"]
_HINTS = ["", "conversion", "bonafide", "odd", None]

_PICKS = [("origin_raw", "o_orderkey", _ORIGINS), ("origin_raw2", "o_custkey", _ORIGINS),
          ("split_raw", "o_orderkey", _SPLITS), ("manifest_name", "o_custkey", _NAMES),
          ("number_raw", "o_orderkey", _NUMBERS), ("flag_raw", "o_orderkey", _FLAGS),
          ("stem_raw", "o_orderkey", _STEMS), ("folder_raw", "o_custkey", _FOLDERS),
          ("manip_raw", "o_orderkey", _MANIPS), ("gt_origin", "o_custkey", _GT),
          ("gt_manip", "o_custkey", _GT_MANIPS), ("status_raw", "o_orderkey", _STATUSES),
          ("hint_raw", "o_custkey", _HINTS)]


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


RAW_SQL = f"""
SELECT o_orderkey AS row_id, o_custkey AS group_no, o_totalprice / CAST(500000 AS DOUBLE) AS p1, (o_orderkey % 100) / CAST(100 AS DOUBLE) AS p2,
  {_sql_list(_TOKENS_A)}[1 + o_custkey % {len(_TOKENS_A)}] || {_sql_list(_SEPARATORS)}[1 + o_orderkey % {len(_SEPARATORS)}]
    || {_sql_list(_TOKENS_B)}[1 + o_orderkey % {len(_TOKENS_B)}] AS labels_raw,
  {", ".join(f"{_sql_list(v)}[1 + {k} % {len(v)}] AS {n}" for n, k, v in _PICKS)},
  '/Data/' || {_sql_list(_FOLDERS)}[1 + o_custkey % {len(_FOLDERS)}] || '/' || {_sql_list(_STEMS)}[1 + o_orderkey % {len(_STEMS)}] || '.wav' AS path_raw
FROM orders
"""


def _pick(values, key):
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (F.col(key) % len(values) + 1).cast("int"))


def raw_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as one row whose text columns cycle through clean and broken values."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("group_no"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("p1"),
        ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("p2"),
        F.concat(_pick(_TOKENS_A, "o_custkey"), _pick(_SEPARATORS, "o_orderkey"),
                 _pick(_TOKENS_B, "o_orderkey")).alias("labels_raw"),
        *[_pick(v, k).alias(n) for n, k, v in _PICKS],
        F.concat(F.lit("/Data/"), _pick(_FOLDERS, "o_custkey"), F.lit("/"),
                 _pick(_STEMS, "o_orderkey"), F.lit(".wav")).alias("path_raw"),
    )
