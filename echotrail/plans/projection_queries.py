"""Normalisation, targets, rules and filters, one output row per input row."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import labels as L
from echotrail.functions import numbers as N
from echotrail.functions import text as T
from echotrail.operators.columns import (
    clean_feature_matrix, drop_artifacts, enough_filled, feature_columns, first_filled_column, tidy_headers,
)
from echotrail.operators.joins import coalesce_suffix, prefixed
from echotrail.operators.profile import issue_rows
from echotrail.plans import inputs as I
from echotrail.plans.profile_queries import BUCKET, duration_bucket
from echotrail.plans.registry import query

R = f"WITH r AS ({I.RAW_SQL})"
c = F.col


def sql_map(table, expr):
    return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def sql_in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def origin_sql(col):
    t = f"lower(trim(coalesce({col}, '')))"
    return (f"CASE WHEN {t} IN {sql_in(L.DIRECT_SYNTHETIC)} THEN 'ai_synthetic' ELSE coalesce({sql_map(L.ORIGIN_ALIASES, t)}, "
            f"CASE WHEN {t} IN {sql_in(L.ORIGIN_LABELS)} THEN {t} END, 'unknown') END")


@query("p1_header_names", """SELECT o_orderkey AS audio_path, o_totalprice AS duration_sec, o_custkey AS sample_rate, o_orderstatus AS other FROM orders""")
def header_names(spark, sf):
    df = I.table(spark, sf, "orders").select(c("o_orderkey").alias(" FilePath "), c("o_totalprice").alias("DURATION"),
                                             c("o_custkey").alias("sr"), c("o_orderstatus").alias("Other"))
    return tidy_headers(df)


@query("p2_origin_label", f"{R} SELECT row_id, {origin_sql('origin_raw')} AS origin FROM r")
def origin_label(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", L.origin_label(c("origin_raw")).alias("origin"))


@query("p3_manipulation_labels", f"""{R}, u AS (SELECT row_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS pos FROM (SELECT row_id, string_split_regex(labels_raw, '[;|,]+') AS parts FROM r)),
m AS (SELECT row_id, pos, lower(trim(p)) AS t, coalesce({sql_map(L.MANIPULATION_ALIASES, 'lower(trim(p))')}, lower(trim(p))) AS v FROM u),
k AS (SELECT row_id, v, min(pos) AS pos FROM m WHERE t NOT IN {sql_in(L.DIRECT_SYNTHETIC)} AND v IN {sql_in(L.MANIPULATION_LABELS)} GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS cnt FROM k), j AS (SELECT row_id, string_agg(v, ';' ORDER BY pos) AS labels FROM n WHERE v <> 'clean' OR cnt = 1 GROUP BY row_id)
SELECT r.row_id, coalesce(labels, 'na') AS labels FROM r LEFT JOIN j USING (row_id)""")
def manipulation_labels(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", L.manipulation_labels(c("labels_raw")).alias("labels"))


@query("p4_inferred_origin", f"""{R} SELECT row_id, CASE WHEN list_has_any(list_transform(string_split_regex(labels_raw, '[;|,]+'), lambda x: lower(trim(x))), {I._sql_list(L.DIRECT_SYNTHETIC)}) THEN 'ai_synthetic'
  ELSE coalesce(nullif({origin_sql('origin_raw')}, 'na'), nullif({origin_sql('origin_raw2')}, 'na'), 'na') END AS origin FROM r""")
def inferred_origin(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", L.infer_origin(
        [c("origin_raw"), c("origin_raw2")], [c("labels_raw")]).alias("origin"))


SPLIT_SQL = f"""CASE WHEN lower(trim(split_raw)) IN {sql_in(L.SPLITS)} THEN lower(trim(split_raw)) WHEN lower(trim(split_raw)) IN ('validation', 'valid') THEN 'val'
  WHEN lower(trim(split_raw)) IN ('eval', 'evaluation') THEN 'eval_only' WHEN contains(lower(manifest_name), 'train') THEN 'train'
  WHEN contains(lower(manifest_name), 'val') THEN 'val' WHEN contains(lower(manifest_name), 'test') THEN 'test' ELSE 'none' END"""


@query("p5_inferred_split", f"{R} SELECT row_id, {SPLIT_SQL} AS split FROM r")
def inferred_split(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", L.infer_split(c("split_raw"), c("manifest_name")).alias("split"))


def slug_sql(col, n):
    return f"coalesce(nullif(trim(substr(regexp_replace(trim({col}), '[^a-zA-Z0-9._-]+', '_', 'g'), 1, {n}), '_'), ''), 'row')"


@query("p6_source_dataset", f"""WITH s AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN ' ' ELSE url END AS src FROM pages)
SELECT page_id, {slug_sql('url', 80)} AS slug, CASE WHEN nullif(trim(src), '') IS NOT NULL THEN {slug_sql('src', 40)} WHEN contains(lower(url), 'asvspoof') THEN 'asvspoof'
  WHEN contains(lower(url), 'features') THEN 'features' ELSE {slug_sql('url', 40)} END AS source_dataset FROM s""")
def source_dataset(spark, sf):
    p = I.table(spark, sf, "pages")
    src = F.when(c("page_id") % 3 == 0, F.lit(None).cast("string")).when(c("page_id") % 3 == 1, " ").otherwise(c("url"))
    low = F.lower("url")
    return p.select("page_id", T.slug(c("url"), 80).alias("slug"), F.coalesce(
        T.slug(T.not_blank(src), 40), F.when(low.contains("asvspoof"), "asvspoof").when(low.contains("features"), "features"),
        T.slug(c("url"), 40)).alias("source_dataset"))


@query("p7_stable_id", f"""SELECT page_id, 'pages_list_' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '_' ||
  CASE WHEN page_id % 2 = 0 THEN {slug_sql('url', 80)} ELSE substr(sha256(url), 1, 12) END AS file_id FROM pages""")
def stable_id(spark, sf):
    name = F.when(c("page_id") % 2 == 0, c("url"))
    return I.table(spark, sf, "pages").select("page_id", T.stable_id(
        F.lit("pages list"), c("page_id"), name, c("url")).alias("file_id"))


def has(col, *words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def first_sql(col, rules, default):
    return "CASE " + " ".join(f"WHEN {has(col, *w)} THEN '{lab}'" for lab, w in rules) + f" ELSE '{default}' END"


@query("p8_path_labels", f"""{R}, p AS (SELECT row_id, lower(path_raw) AS p FROM r)
SELECT row_id, {first_sql('p', T.DOMAIN_WORDS, 'unknown')} AS domain, {first_sql('p', T.DATASET_WORDS, 'unknown')} AS dataset,
  CASE WHEN {has('p', *T.SPOOF_WORDS)} THEN 'spoof' ELSE 'bonafide' END AS label,
  CASE WHEN {has('p', *T.SPOOF_WORDS)} THEN {first_sql('p', T.ATTACK_WORDS, 'synthesis')} ELSE 'bonafide' END AS attack_type FROM p""")
def path_labels(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", *[v.alias(k) for k, v in T.path_labels(c("path_raw")).items()])


STEM = "regexp_replace(list_extract(string_split(replace(trim({c}), chr(92), '/'), '/'), -1), '(.)\\.[^.]*$', '\\1')"


@query("p9_speaker_id", f"""{R}, s AS (SELECT row_id, {STEM.format(c='path_raw')} AS stem FROM r),
h AS (SELECT row_id, stem, list_filter(string_split(stem, '_'), lambda x: starts_with(x, 'spk') OR starts_with(x, 'speaker') OR regexp_full_match(x, '[0-9]{{3,}}'))[1] AS f FROM s)
SELECT row_id, CASE WHEN f IS NULL THEN 'spk_' || substr(md5(stem), 1, 8) WHEN starts_with(f, 'spk') OR starts_with(f, 'speaker') THEN f ELSE 'spk_' || f END AS speaker_id FROM h""")
def speaker_id(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", T.speaker_from_name(c("path_raw")).alias("speaker_id"))


@query("p10_file_category", f"""{R}, q AS (SELECT row_id, lower(replace(path_raw, chr(92), '/')) AS p, lower({STEM.format(c='path_raw')}) AS s FROM r),
f AS (SELECT *, regexp_extract(p, '(?:^|/)raw/([^/]+)', 1) AS folder FROM q)
SELECT row_id, CASE WHEN folder IN {sql_in(T.FOLDER_CATEGORIES)} THEN folder
  WHEN contains(s, 'fabricated') THEN CASE WHEN starts_with(s, 'human_') OR contains(p, '/human_fabricated/') THEN 'human_fabricated' ELSE 'ai_fabricated' END
  WHEN contains(s, 'mixer') OR contains(p, '/ai_mixer/') OR contains(p, '/human_mixer/') THEN CASE WHEN contains(s, 'ai_') OR contains(p, '/ai_mixer/') THEN 'ai_mixer' ELSE 'human_mixer' END
  WHEN contains(s, 'replay') OR contains(s, 'repeat') THEN CASE WHEN starts_with(s, 'human_') OR contains(p, '/human_repeat/') OR contains(p, '/human_replay/') THEN 'human_replay' ELSE 'ai_replay' END
  WHEN contains(s, 'direct') OR contains(p, '/ai_direct/') OR contains(p, '/human_direct/') OR contains(p, '/human_clean/') THEN CASE WHEN starts_with(s, 'human_') OR contains(p, '/human_') THEN 'human_direct' ELSE 'ai_direct' END
  ELSE 'unknown' END AS file_category FROM f""")
def file_category(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", T.file_category(c("path_raw")).alias("file_category"))


@query("p11_variant_and_base", f"""{R}, s AS (SELECT row_id, trim(regexp_replace(lower(stem_raw), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM r),
x AS (SELECT row_id, regexp_extract(s, '^(human|ai)_[0-9]+', 1) AS sp, regexp_extract(s, '^(?:human|ai)_([0-9]+)', 1) AS d, regexp_extract(s, '^(?:human|ai)_[0-9]+_?(.*)$', 1) AS rest FROM s),
k AS (SELECT *, CASE WHEN contains(rest, 'fabricated') OR contains(rest, 'partial_fake') OR contains(rest, 'fake_20pct') THEN 'fabricated' WHEN contains(rest, 'mixer') THEN 'mixer'
  WHEN contains(rest, 'replay') THEN 'replayed' WHEN rest IN ('clean', 'direct') OR ends_with(rest, '_clean') OR ends_with(rest, '_direct') THEN 'clean' END AS kind FROM x)
SELECT row_id, CASE WHEN sp <> '' AND kind IS NOT NULL THEN sp || '_' || kind END AS variant, CASE WHEN sp <> '' AND kind IS NOT NULL THEN CASE WHEN length(d) >= 3 THEN d ELSE lpad(d, 3, '0') END END AS base_id FROM k""")
def variant_and_base(spark, sf):
    v, b = T.variant_and_base(c("stem_raw"))
    return I.raw_labels(spark, sf).select("row_id", v.alias("variant"), b.alias("base_id"))


@query("p12_category_maps", f"""{R}, k AS (SELECT row_id, ['ai_repeat', 'human_replay', 'ai_direct', 'human_clean', 'human_mixer', 'ai_fabricated', 'odd'][1 + row_id % 7] AS cat FROM r),
m AS (SELECT row_id, cat, CASE WHEN cat IN ('ai_repeat', 'human_repeat', 'ai_replay', 'human_replay') THEN replace(cat, 'repeat', 'replay') ELSE cat END AS mapped FROM k)
SELECT row_id, mapped, CASE WHEN mapped IN ('ai_direct', 'human_direct', 'human_clean') THEN 'clean_direct_negative' WHEN mapped IN ('ai_replay', 'human_replay') THEN 'replay_negative'
  WHEN mapped IN ('ai_mixer', 'human_mixer') THEN 'mixer_negative' END AS negative_type, CASE WHEN cat IN ('ai_fabricated', 'human_fabricated') THEN cat ELSE 'none' END AS direction FROM m""")
def category_maps(spark, sf):
    cat = F.element_at(F.array(*[F.lit(x) for x in ("ai_repeat", "human_replay", "ai_direct", "human_clean", "human_mixer",
                                                    "ai_fabricated", "odd")]), (c("row_id") % 7 + 1).cast("int"))
    return I.raw_labels(spark, sf).select("row_id", L.replay_category(cat).alias("mapped"),
                                          L.negative_source_type(cat).alias("negative_type"), L.fabrication_direction(cat).alias("direction"))


@query("p13_source_group", f"""{R}, g AS (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN ' Base_' || CAST(group_no AS VARCHAR) END AS sid, lower(stem_raw || '.wav') AS f FROM r)
SELECT row_id, coalesce(lower(trim(sid)), nullif(trim(regexp_replace(regexp_replace(regexp_replace(f, '\\.(wav|mp3|flac|m4a|ogg)$', ''),
  '(replay|mixer|mix|partial|fabricated|ai|human|clean|segment|chunk|aug|copy|version|v[0-9]+)', '', 'g'), '[_\\-/\\s]+', '_', 'g'), '_'), ''), 'unknown_group') AS source_group_id FROM g""")
def source_group(spark, sf):
    sid = F.when(c("row_id") % 5 == 0, F.concat(F.lit(" Base_"), c("group_no").cast("string")))
    return I.raw_labels(spark, sf).select("row_id", T.source_group(
        sid, F.concat("stem_raw", F.lit(".wav"))).alias("source_group_id"))


SETS = ["clean", "clean;replay_rerecorded", "replay_rerecorded", "mixer_channel_processed", "partial_fabrication", "NA", "clean,edited_spliced", "mixed", ""]
TARGET_CTE = f"""{R}, b AS (SELECT row_id, lower(trim({I._sql_list(['human', 'ai_synthetic', 'mixed', 'unknown', ''])}[1 + group_no % 5])) AS o, {I._sql_list(SETS)}[1 + row_id % {len(SETS)}] AS labels FROM r),
s AS (SELECT *, CASE WHEN lower(labels) IN ('', 'nan', 'none', 'null', 'na') THEN [] ELSE string_split(replace(lower(labels), ',', ';'), ';') END AS ls FROM b),
f AS (SELECT *, contains(o, 'mixed') OR list_contains(ls, 'mixed') AS mixed, list_contains(ls, 'replay_rerecorded') AS rep, list_contains(ls, 'mixer_channel_processed') AS mix,
  list_contains(ls, 'partial_fabrication') AS par, list_contains(ls, 'clean') AS cle, list_has_any(ls, ['edited_spliced', 'unknown_manipulation', 'compressed_low_quality']) AS oth FROM s),
t AS (SELECT row_id, CASE WHEN mixed THEN 'mixed' WHEN o IN ('human', 'ai_synthetic') THEN o ELSE 'unknown' END AS target_origin_multiclass,
  CASE WHEN NOT mixed AND o = 'human' THEN '0' WHEN NOT mixed AND o = 'ai_synthetic' THEN '1' END AS target_is_ai_synthetic, rep, mix, par, cle, oth, mixed, o FROM f)"""


def b01(x):
    return f"CASE WHEN {x} THEN '1' ELSE '0' END"


def btf(x):
    return f"CASE WHEN {x} THEN 'true' ELSE 'false' END"


FILE_TARGETS_SQL = f"""SELECT row_id, target_origin_multiclass, target_is_ai_synthetic, {b01('rep')} AS target_is_replay, {b01('mix')} AS target_is_mixer_channel,
  {b01('par')} AS target_is_partial_fabrication_file, {b01('cle')} AS target_is_clean, {btf("NOT mixed AND o IN ('human', 'ai_synthetic') AND cle")} AS eligible_origin_file_model,
  {btf('(rep OR cle) AND NOT mix AND NOT par AND NOT oth AND NOT mixed')} AS eligible_replay_file_model, {btf('(mix OR cle) AND NOT rep AND NOT par AND NOT oth AND NOT mixed')} AS eligible_mixer_file_model,
  {btf('par')} AS eligible_partial_file_context_only, 'false' AS eligible_partial_segment_training FROM t"""


def target_inputs(spark, sf):
    return I.raw_labels(spark, sf).select(
        "row_id", "group_no", I._pick(["human", "ai_synthetic", "mixed", "unknown", ""], "group_no").alias("o"),
        I._pick(SETS, "row_id").alias("labels"))


@query("p14_file_targets", f"{TARGET_CTE} {FILE_TARGETS_SQL}")
def file_targets(spark, sf):
    return target_inputs(spark, sf).select("row_id", *[v.alias(k) for k, v in L.file_targets(c("o"), c("labels")).items()])


@query("p15_segment_targets", f"""{TARGET_CTE}, g AS (SELECT *, CASE row_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'strange' END AS given, CASE WHEN row_id % 3 = 0 THEN 1.5 END AS st FROM t),
h AS (SELECT *, CASE WHEN given IS NOT NULL THEN given WHEN st IS NOT NULL THEN 'true_segment_timestamp' ELSE 'file_level_inherited' END AS src FROM g)
SELECT row_id, target_origin_multiclass AS inherited_target_origin_multiclass, {b01('rep')} AS inherited_target_is_replay, {b01('mix')} AS inherited_target_is_mixer_channel,
  {b01('par')} AS inherited_target_is_partial_fabrication_file, {b01('cle')} AS inherited_target_is_clean,
  CASE WHEN src IN ('file_level_inherited', 'true_segment_timestamp', 'unknown') THEN src ELSE 'unknown' END AS segment_label_source,
  {btf("target_origin_multiclass IN ('human', 'ai_synthetic')")} AS eligible_segment_origin_context, {btf("src = 'true_segment_timestamp' AND par")} AS eligible_partial_segment_training FROM h""")
def segment_targets(spark, sf):
    k = c("row_id")
    given = F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "strange")
    start = F.when(k % 3 == 0, 1.5)
    out = L.segment_targets(c("o"), c("labels"), given, start, F.lit(None).cast("double"))
    return target_inputs(spark, sf).select("row_id", *[v.alias(n) for n, v in out.items()])


@query("p16_label_membership", f"""{TARGET_CTE} SELECT row_id, cle AS has_clean, rep AS has_replay FROM f""")
def label_membership(spark, sf):
    return target_inputs(spark, sf).select("row_id", L.has_label(c("labels"), "clean").alias("has_clean"),
                                           L.has_label(c("labels"), "replay_rerecorded").alias("has_replay"))


@query("p17_boolean_text", f"""{R} SELECT row_id, CASE WHEN lower(trim(flag_raw)) IN ('1', 'true', 'yes', 'y') THEN '1' WHEN lower(trim(flag_raw)) IN ('0', 'false', 'no', 'n') THEN '0' END AS flag FROM r""")
def boolean_text(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", N.to_flag(c("flag_raw")).alias("flag"))


@query("p18_tolerant_number", f"""{R}, n AS (SELECT row_id, TRY_CAST(trim(number_raw) AS DOUBLE) AS x FROM r) SELECT row_id, CASE WHEN isfinite(x) THEN x END AS number FROM n""")
def tolerant_number(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", N.to_number(c("number_raw")).alias("number"))


@query("p19_clock_time", f"""{R}, n AS (SELECT row_id, trim(number_raw) AS t, string_split(trim(number_raw), ':') AS p FROM r),
v AS (SELECT row_id, t, len(p) AS n, TRY_CAST(p[1] AS DOUBLE) AS a, TRY_CAST(p[2] AS DOUBLE) AS b, TRY_CAST(p[3] AS DOUBLE) AS d FROM n)
SELECT row_id, CASE WHEN n = 1 AND isfinite(a) THEN a WHEN n = 2 THEN a * 60 + b WHEN n = 3 THEN a * 3600 + b * 60 + d END AS seconds,
  CASE WHEN n = 1 AND isfinite(a) THEN a / 1000 END AS from_ms FROM v""")
def clock_time(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", N.clock_seconds(c("number_raw")).alias("seconds"),
                                          N.clock_seconds(c("number_raw"), milliseconds=True).alias("from_ms"))


def hint_sql(default):
    return f"""CASE WHEN h IN ('conversion', 'voice_conversion') THEN 'voice_conversion' WHEN h IN {sql_in(L.ATTACK_HINTS)} THEN h
      WHEN h = '' THEN '{'voice_conversion' if default == 'voice_conversion' else default}' WHEN p1 > p2 + 0.1::DOUBLE THEN 'voice_conversion' WHEN p2 > p1 + 0.1::DOUBLE THEN 'synthesis' ELSE '{default}' END"""


LABEL_SQL = f"""{R}, b AS (SELECT *, manip_raw AS m, gt_origin AS o, lower(trim(coalesce(hint_raw, ''))) AS h, CASE WHEN p1 >= 0.7 THEN 'FAKE' ELSE 'REAL' END AS pred,
   CASE gt_origin WHEN 'human' THEN 'human_likely' WHEN 'ai' THEN 'ai_likely' ELSE 'uncertain' END AS side FROM r),
n AS (SELECT *, CASE WHEN m = 'clean_direct' AND o = 'human' THEN 'human_likely' WHEN m = 'clean_direct' AND o = 'ai' THEN 'ai_likely' WHEN m = 'human_replay' THEN 'human_likely' WHEN m = 'ai_replay' THEN 'ai_likely'
  WHEN m IN ('mixer_processed', 'whatsapp_compressed', 'youtube_broadcast', 'phone_recorded', 'noisy_room') THEN side WHEN m = 'edited_spliced' THEN CASE WHEN o = 'mixed' THEN 'mixed_or_partial_ai' ELSE 'human_likely' END
  WHEN m = 'partial_ai_insert' THEN 'mixed_or_partial_ai' ELSE 'uncertain' END AS origin_label,
  CASE WHEN m = 'clean_direct' AND o IN ('human', 'ai') THEN 'clean_original' WHEN m IN ('human_replay', 'ai_replay') THEN 'replayed_or_re_recorded' WHEN m IN ('mixer_processed', 'phone_recorded') THEN 'channel_processed'
  WHEN m IN ('whatsapp_compressed', 'youtube_broadcast') THEN 'platform_compressed' WHEN m IN ('edited_spliced', 'partial_ai_insert') THEN 'edited_or_spliced' WHEN m = 'noisy_room' THEN 'noisy_low_quality' ELSE 'uncertain' END AS manipulation_label,
  CASE WHEN m = 'clean_direct' AND o = 'human' THEN 'bonafide' WHEN m = 'clean_direct' AND o = 'ai' THEN {hint_sql('synthesis')} WHEN m = 'human_replay' THEN 'replay' WHEN m = 'ai_replay' THEN {hint_sql('replay')}
  WHEN m = 'mixer_processed' AND o = 'ai' THEN {hint_sql('voice_conversion')} WHEN m IN ('mixer_processed', 'edited_spliced') THEN 'unknown' WHEN m = 'partial_ai_insert' THEN {hint_sql('voice_conversion')} ELSE {hint_sql('unknown')} END AS attack_hint,
  CASE WHEN m = 'clean_direct' AND o = 'human' THEN CASE WHEN status_raw = 'clean_human_borderline' THEN 'inconclusive' ELSE 'low' END
  WHEN m = 'clean_direct' AND o = 'ai' THEN CASE WHEN status_raw IN ('direct_ai_detected', 'direct_ai_missed') THEN 'high' ELSE 'medium' END
  WHEN m = 'human_replay' THEN CASE WHEN pred = 'FAKE' THEN 'high' ELSE 'medium' END WHEN m IN ('ai_replay', 'partial_ai_insert') THEN 'high' ELSE 'medium' END AS risk_level FROM b)"""


@query("p20_forensic_labels", f"""{LABEL_SQL} SELECT row_id, origin_label, manipulation_label, attack_hint, risk_level,
  CASE WHEN origin_label = 'uncertain' THEN 'unknown' WHEN o IN ('human', 'ai', 'mixed') THEN o ELSE 'unknown' END AS origin_binary,
  CASE WHEN manipulation_label IN ('uncertain', 'noisy_low_quality') OR gt_manip = 'unknown' THEN 'uncertain' WHEN manipulation_label = 'clean_original' AND m = 'clean_direct' THEN 'clean' ELSE 'manipulated' END AS manipulation_binary,
  CASE WHEN m = 'partial_ai_insert' THEN 1 ELSE 0 END AS partial_fabrication_binary FROM n""")
def forensic_labels(spark, sf):
    none = F.lit(None).cast("string")
    out = L.forensic_labels(c("manip_raw"), c("gt_origin"), c("gt_manip"), c("status_raw"),
                            F.when(c("p1") >= 0.7, "FAKE").otherwise("REAL"), c("hint_raw"), c("p1"), c("p2"), none, none, none)
    return I.raw_labels(spark, sf).select("row_id", *[v.alias(k) for k, v in out.items()])


@query("p21_review_flags", f"""{LABEL_SQL}, f AS (SELECT row_id, p1 < 0.9 AS ex, m = 'partial_ai_insert' AND row_id % 3 = 0 AS noreg, status_raw IN {sql_in(L.REVIEW_STATUSES)} AS listed,
  ends_with(status_raw, '_missed') AND group_no % 2 <> 0 AS missed, origin_label = 'uncertain' AS unsure, status_raw FROM n)
SELECT row_id, CASE WHEN NOT ex THEN 'rejected' WHEN noreg OR listed THEN 'needs_review' WHEN missed THEN 'approved' WHEN unsure THEN 'needs_review' ELSE 'approved' END AS review_status,
  CASE WHEN NOT ex OR noreg THEN 'low' WHEN listed THEN CASE WHEN status_raw = 'clean_human_borderline' THEN 'medium' ELSE 'low' END WHEN missed THEN 'medium' WHEN unsure THEN 'low' ELSE 'high' END AS label_confidence,
  ex AND NOT noreg AND NOT listed AND (missed OR NOT unsure) AS use_for_validation,
  CASE WHEN NOT ex THEN 'audio_not_found' WHEN noreg OR status_raw = 'partial_not_evaluated_missing_timestamp' THEN 'missing_partial_fabrication_timestamps' ELSE '' END AS exclusion_reason FROM f""")
def review_flags(spark, sf):
    none = F.lit(None).cast("string")
    labels = L.forensic_labels(c("manip_raw"), c("gt_origin"), c("gt_manip"), c("status_raw"), none, c("hint_raw"),
                               c("p1"), c("p2"), none, none, none)
    end = F.when(c("row_id") % 3 != 0, 2.0)
    out = L.review_flags(c("manip_raw"), c("status_raw"), c("p1") < 0.9, F.lit(1.0), end,
                         c("group_no") % 2 == 0, labels["origin_label"])
    return I.raw_labels(spark, sf).select("row_id", *[v.alias(k) for k, v in out.items()])


MAN = f"WITH m AS ({I.MANIFEST_SQL})"
GROUP_SQL = "CASE WHEN label = 'bonafide' OR attack_type = 'bonafide' THEN 'bonafide' WHEN label = 'spoof' AND attack_type IN ('synthesis', 'conversion', 'replay') THEN attack_type END"


@query("p22_attack_group", f"{MAN} SELECT doc_id, {GROUP_SQL} AS attack_group FROM m")
def attack_group(spark, sf):
    return I.manifest(spark, sf).select("doc_id", L.attack_group(c("label"), c("attack_type")).alias("attack_group"))


WEIGHT_SQL = f"""w AS (SELECT *, CASE m WHEN 'partial_ai_insert' THEN 3.0 WHEN 'clean_direct' THEN 2.5 WHEN 'human_replay' THEN 2.5 WHEN 'ai_replay' THEN 2.0 WHEN 'mixer_processed' THEN CASE WHEN o = 'ai' THEN 2.0 ELSE 2.5 END ELSE 2.0 END::DOUBLE AS base,
  'p7c1_' || CASE m WHEN 'partial_ai_insert' THEN 'partial_fabrication' WHEN 'clean_direct' THEN 'clean_direct_' || CASE WHEN o IN ('human', 'ai') THEN o ELSE 'ai' END WHEN 'human_replay' THEN m WHEN 'ai_replay' THEN m
   WHEN 'mixer_processed' THEN 'mixer_' || CASE WHEN o IN ('human', 'ai') THEN o ELSE 'human' END ELSE 'default' END AS why,
  CASE status_raw WHEN 'clean_human_false_alarm' THEN 0.5 WHEN 'direct_ai_file_level_missed_but_segment_suspicious' THEN 0.5 WHEN 'direct_ai_missed' THEN 0.75 WHEN 'partial_fabrication_missed' THEN 0.75 END::DOUBLE AS bonus FROM n)"""


@query("p23_sample_weights", f"""{LABEL_SQL}, {WEIGHT_SQL}, v AS (SELECT *, CASE WHEN row_id % 2 = 0 THEN 'old' ELSE 'new' END AS src, CASE WHEN group_no % 4 = 0 THEN '' ELSE m END AS role, CASE WHEN o = 'human' THEN 0 ELSE 1 END AS risk FROM w)
SELECT row_id, round(least(4.0::DOUBLE, greatest(0.1::DOUBLE, base + coalesce(bonus, 0))), 4) AS sample_weight, why || CASE WHEN bonus IS NULL THEN '' ELSE '+baseline_' || status_raw END AS weight_reason,
  least(4.0::DOUBLE, greatest(CASE WHEN src = 'old' THEN 1.0 WHEN contains(role, 'clean_human') THEN 4.0 WHEN contains(role, 'direct_ai') THEN 3.0 WHEN contains(role, 'partial') THEN 2.5 ELSE 2.0 END::DOUBLE, CASE WHEN row_id % 5 <> 0 THEN p1 * 10 END * 0.5::DOUBLE)) AS window_weight,
  CASE WHEN src = 'old' AND risk = 0 THEN 'old_bonafide' WHEN src = 'old' THEN 'old_' || coalesce(nullif(role, ''), 'spoof') WHEN contains(role, 'clean_human') THEN 'phase7c1_clean_human_boost' WHEN contains(role, 'direct_ai') THEN 'phase7c1_direct_ai'
   WHEN contains(role, 'partial') THEN 'phase7c1_partial_fabrication' ELSE 'phase7c1_' || coalesce(nullif(role, ''), 'risk_positive') END AS window_reason FROM v""")
def sample_weights(spark, sf):
    w, why = L.collection_weight(c("manip_raw"), c("gt_origin"), c("status_raw"))
    src = F.when(c("row_id") % 2 == 0, "old").otherwise("new")
    role = F.when(c("group_no") % 4 == 0, "").otherwise(c("manip_raw"))
    w2, why2 = L.window_weight(src, role, F.when(c("gt_origin") == "human", 0).otherwise(1),
                               F.when(c("row_id") % 5 != 0, c("p1") * 10))
    return I.raw_labels(spark, sf).select("row_id", w.alias("sample_weight"), why.alias("weight_reason"),
                                          w2.alias("window_weight"), why2.alias("window_reason"))


RISK_SQL = """CASE WHEN m IN ('partial_ai_insert', 'edited_spliced', 'edited_or_spliced') THEN ['1', 'partial_fabrication'] WHEN m = 'clean_direct' AND o = 'human' AND gt_manip IN ('clean', '') THEN ['0', 'clean_human']
  WHEN m = 'clean_direct' AND o = 'ai' THEN ['1', 'direct_ai'] WHEN m IN ('human_replay', 'ai_replay') THEN ['1', m] WHEN m = 'mixer_processed' THEN ['1', CASE WHEN o = 'human' THEN 'human_mixer' ELSE 'ai_mixer' END]
  WHEN m IN ('whatsapp_compressed', 'youtube_broadcast', 'phone_recorded', 'noisy_room') THEN ['1', CASE WHEN o = 'ai' THEN 'ai_processed' ELSE 'human_processed' END]
  WHEN gt_manip = 'clean' AND o = 'human' THEN ['0', 'clean_human'] WHEN gt_manip IN ('replayed', 'processed', 'mixed') THEN ['1', 'manipulation_risk'] ELSE [NULL, 'needs_review'] END"""


@query("p24_legacy_risk", f"""{MAN}, b AS (SELECT doc_id, lower(trim(coalesce(label, ''))) AS l, lower(trim(coalesce(attack_type, ''))) AS a FROM m)
SELECT doc_id, CASE WHEN a = 'bonafide' OR l = 'bonafide' THEN '0' WHEN a IN ('synthesis', 'conversion', 'replay') OR l IN ('spoof', 'fake') THEN '1' END AS risk,
  CASE WHEN a = 'bonafide' OR l = 'bonafide' THEN 'old_bonafide' WHEN a IN ('synthesis', 'conversion', 'replay') THEN 'old_' || a WHEN l IN ('spoof', 'fake') THEN 'old_' || coalesce(nullif(a, ''), l) ELSE '' END AS role FROM b""")
def legacy_risk(spark, sf):
    out = L.legacy_risk(c("attack_type"), c("label"))
    return I.manifest(spark, sf).select("doc_id", out["risk"].alias("risk"), out["role"].alias("role"))


@query("p25_duration_bucket", f"{MAN}, x AS (SELECT doc_id, duration AS d FROM m WHERE duration IS NOT NULL) SELECT doc_id, {BUCKET} AS bucket FROM x")
def duration_buckets(spark, sf):
    return I.manifest(spark, sf).where(c("duration").isNotNull()).select("doc_id", duration_bucket(c("duration")).alias("bucket"))


@query("p26_path_parts", f"""{R}, p AS (SELECT row_id, replace(trim(path_raw), chr(92), '/') AS path FROM r)
SELECT row_id, path, list_extract(string_split(path, '/'), -1) AS base_name, lower({STEM.format(c='path')}) AS stem, trim(regexp_replace(lower({STEM.format(c='path')}), '[^a-z0-9_]+', '_', 'g'), '_') AS name_key FROM p""")
def path_parts(spark, sf):
    p = c("path_raw")
    return I.raw_labels(spark, sf).select("row_id", T.clean_path(p).alias("path"), T.base_name(p).alias("base_name"),
                                          T.lower_stem(p).alias("stem"), T.name_key(p).alias("name_key"))


def named_features(spark, sf):
    return I.segments(spark, sf).select("file_id", "segment_id", c("f_quantity").alias("rms_mean"), c("f_price").alias("spectral_centroid"),
                                        c("f_discount").alias("ssl_emb_000"), c("f_tax").alias("snr_proxy"), c("prob").alias("replay_score"))


@query("p27_feature_selection", f"""WITH g AS ({I.SEGMENTS_SQL}) SELECT file_id, segment_id, f_quantity AS rms_mean, f_tax AS snr_proxy, f_price AS spectral_centroid, f_discount AS ssl_emb_000 FROM g""")
def feature_selection(spark, sf):
    df = named_features(spark, sf)
    return df.select("file_id", "segment_id", *feature_columns(df.columns, "combined"))


@query("p28_column_cleanup", f"""WITH g AS ({I.SEGMENTS_SQL}) SELECT 'v1' AS schema_version, file_id, segment_id, f_quantity AS rms_mean, f_price AS spectral_centroid, f_discount AS ssl_emb_000, f_tax AS snr_proxy FROM g""")
def column_cleanup(spark, sf):
    df = (named_features(spark, sf).withColumn("schema_version_x", F.lit("old")).withColumn("rms_mean_dup", c("rms_mean"))
          .withColumn("schema_version", F.lit("older")))
    return drop_artifacts(df, {"replay_score", "quality_score"}, "v1")


@query("p29_enough_features", f"""{R} SELECT row_id, (CASE WHEN nullif(trim(number_raw), '') IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN nullif(trim(split_raw), '') IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN nullif(trim(hint_raw), '') IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN nullif(trim(flag_raw), '') IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN nullif(trim(origin_raw), '') IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN nullif(trim(origin_raw2), '') IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN nullif(trim(gt_manip), '') IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END) >= 2 AS enough FROM r""")
def enough_features(spark, sf):
    df = I.raw_labels(spark, sf).withColumn("p1_text", F.when(c("p1") > 0.5, c("p1")).cast("string"))
    cols = ["number_raw", "split_raw", "hint_raw", "flag_raw", "origin_raw", "origin_raw2", "gt_manip", "p1_text"]
    return df.select("row_id", enough_filled(cols).alias("enough"))


@query("p30_task_sets", f"""{TARGET_CTE}, ft AS ({FILE_TARGETS_SQL})
SELECT 'origin' AS task, row_id FROM ft WHERE eligible_origin_file_model = 'true' AND target_origin_multiclass IN ('human', 'ai_synthetic')
UNION ALL SELECT 'replay', row_id FROM ft WHERE eligible_replay_file_model = 'true' AND (target_is_replay = '1' OR target_is_clean = '1') AND target_is_mixer_channel = '0' AND target_is_partial_fabrication_file = '0'
UNION ALL SELECT 'mixer', row_id FROM ft WHERE eligible_mixer_file_model = 'true' AND (target_is_mixer_channel = '1' OR target_is_clean = '1') AND target_is_replay = '0' AND target_is_partial_fabrication_file = '0'
UNION ALL SELECT 'partial', row_id FROM ft WHERE target_is_partial_fabrication_file = '1'""")
def task_sets(spark, sf):
    t = target_inputs(spark, sf).select("row_id", *[v.alias(k) for k, v in L.file_targets(c("o"), c("labels")).items()])
    one, zero = (lambda n: c(n) == "1"), (lambda n: c(n) == "0")
    clean, partial = one("target_is_clean"), one("target_is_partial_fabrication_file")
    tasks = {
        "origin": (c("eligible_origin_file_model") == "true") & c("target_origin_multiclass").isin("human", "ai_synthetic"),
        "replay": (c("eligible_replay_file_model") == "true") & (one("target_is_replay") | clean) & zero("target_is_mixer_channel") & ~partial,
        "mixer": (c("eligible_mixer_file_model") == "true") & (one("target_is_mixer_channel") | clean) & zero("target_is_replay") & ~partial,
        "partial": partial}
    return issue_rows(t, tasks, ["row_id"], "task")


@query("p31_trainable_segments", f"""{R}, t AS (SELECT row_id, ['fabricated_region', 'outside_fabricated_region', 'unknown_no_timestamp'][1 + row_id % 3] AS lab, flag_raw FROM r)
SELECT row_id, CASE WHEN lab = 'fabricated_region' THEN 1 ELSE 0 END AS target_partial_fabricated FROM t WHERE lower(flag_raw) = 'true' AND lab IN ('fabricated_region', 'outside_fabricated_region')""")
def trainable_segments(spark, sf):
    lab = I._pick(["fabricated_region", "outside_fabricated_region", "unknown_no_timestamp"], "row_id")
    return (I.raw_labels(spark, sf).withColumn("lab", lab)
            .where((F.lower("flag_raw") == "true") & c("lab").isin("fabricated_region", "outside_fabricated_region"))
            .select("row_id", F.when(c("lab") == "fabricated_region", 1).otherwise(0).alias("target_partial_fabricated")))


# Order in which failures are looked at (fixed values).
ERROR_PRIORITY = {"clean_human_false_alarm": 1, "direct_ai_missed": 2, "partial_fabrication_missed": 3, "ai_replay_missed": 4,
                  "ai_mixer_missed": 5, "human_replay_missed": 6, "human_mixer_missed": 7}


@query("p32_error_cases", f"""{R}, b AS (SELECT row_id, status_raw, CASE WHEN row_id % 97 = 0 THEN 'decode error' END AS error FROM r)
SELECT row_id, status_raw, error, coalesce({sql_map(ERROR_PRIORITY, 'status_raw').replace("THEN '", "THEN ").replace("' WHEN", " WHEN").replace("' END", " END")}, 50) AS priority
FROM b WHERE coalesce(trim(error), '') <> '' OR status_raw IN ('clean_human_borderline', 'direct_ai_missed', 'direct_ai_file_level_missed_but_segment_suspicious', 'clean_human_false_alarm', 'partial_fabrication_missed')""")
def error_cases(spark, sf):
    df = I.raw_labels(spark, sf).select("row_id", "status_raw", F.when(c("row_id") % 97 == 0, "decode error").alias("error"))
    bad = ["clean_human_borderline", "direct_ai_missed", "direct_ai_file_level_missed_but_segment_suspicious",
           "clean_human_false_alarm", "partial_fabrication_missed"]
    rank = F.coalesce(F.try_element_at(L.lookup(ERROR_PRIORITY), c("status_raw")), F.lit(50))
    return (df.where(T.not_blank(c("error")).isNotNull() | c("status_raw").isin(bad))
            .withColumn("priority", rank))


RES = f"WITH b AS ({I.RESULTS_SQL['baseline']})"


@query("p33_prefixed_columns", f"{RES} SELECT sample_id, decision_score AS decision_score_baseline, prediction AS prediction_baseline FROM b")
def prefixed_columns(spark, sf):
    return prefixed(I.model_results(spark, sf).select("sample_id", "decision_score", "prediction"), "baseline")


@query("p34_sample_id", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_totalprice FROM orders")
def sample_id(spark, sf):
    df = I.table(spark, sf, "orders").select(F.lit(" ").alias("sample_id"), F.lit(None).cast("string").alias("test_id"),
                                             c("o_orderkey").cast("string").alias("file_id"), "o_totalprice")
    name = first_filled_column(df, ["sample_id", "test_id", "file_id", "utt_id", "id"])
    return df.select(F.trim(name).alias("sample_id"), "o_totalprice")


@query("p35_coalesced_duplicates", f"""{R} SELECT row_id, coalesce(nullif(trim(origin_raw), ''), origin_raw2) AS origin FROM r""")
def coalesced_duplicates(spark, sf):
    df = I.raw_labels(spark, sf).select("row_id", c("origin_raw").alias("origin"), c("origin_raw2").alias("origin_io"))
    return coalesce_suffix(df, "io")


NOTE_TASKS = {"origin_file_model": ("clean human predicted as AI evidence", "clean AI evidence missed"),
              "replay_file_model": ("clean file predicted as replay evidence", "replay file missed"),
              "mixer_file_model": ("clean file predicted as mixer/channel evidence", "mixer/channel file missed")}


@query("p36_error_types", f"""WITH p AS ({I.PREDICTIONS_SQL}), e AS (SELECT *, CASE WHEN y_true = 1 AND prob >= 0.5 THEN 'true_positive' WHEN y_true = 0 AND prob < 0.5 THEN 'true_negative' WHEN y_true = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type FROM p)
SELECT task_name, error_type, CASE """ + " ".join(
    f"WHEN task_name = '{t}' AND error_type = 'false_positive' THEN '{a}' WHEN task_name = '{t}' AND error_type = 'false_negative' THEN '{b}'" for t, (a, b) in NOTE_TASKS.items()) + """
  WHEN prob >= 0.8 AND error_type = 'true_positive' THEN 'correct high-confidence positive' WHEN prob >= 0.8 THEN 'correct high-confidence negative'
  WHEN prob <= 0.2 THEN 'correct low-confidence output' ELSE 'experimental evidence model output' END AS review_note, count(*) AS n FROM e GROUP BY ALL""")
def error_types(spark, sf):
    y, p = c("y_true"), c("prob")
    kind = (F.when((y == 1) & (p >= 0.5), "true_positive").when((y == 0) & (p < 0.5), "true_negative")
            .when(y == 0, "false_positive").otherwise("false_negative"))
    note = F.when(F.lit(False), "")
    for task, (fp, fn) in NOTE_TASKS.items():
        note = (note.when((c("task_name") == task) & (c("error_type") == "false_positive"), fp)
                .when((c("task_name") == task) & (c("error_type") == "false_negative"), fn))
    note = (note.when((p >= 0.8) & (c("error_type") == "true_positive"), "correct high-confidence positive")
            .when(p >= 0.8, "correct high-confidence negative").when(p <= 0.2, "correct low-confidence output")
            .otherwise("experimental evidence model output"))
    return (I.predictions(spark, sf).withColumn("error_type", kind).withColumn("review_note", note)
            .groupBy("task_name", "error_type", "review_note").agg(F.count(F.lit(1)).alias("n")))


@query("p37_clean_matrix", f"""{R}, n AS (SELECT row_id, TRY_CAST(trim(number_raw) AS DOUBLE) AS x, p1 FROM r) SELECT row_id, CASE WHEN isfinite(x) THEN x END AS number_raw, p1 FROM n""")
def clean_matrix(spark, sf):
    df = I.raw_labels(spark, sf).select("row_id", "number_raw", c("p1").cast("string").alias("p1"),
                                        c("stem_raw").alias("words"), F.lit(" ").alias("empty"))
    return clean_feature_matrix(df, ["number_raw", "p1", "words", "empty"])


@query("p39_training_schema", f"""{MAN}, g AS (SELECT *, {GROUP_SQL} AS grp FROM m), {LABEL_SQL.replace('WITH r AS', 'r AS')}, {WEIGHT_SQL}
SELECT 'old_' || CAST(doc_id AS VARCHAR) AS sample_id, 'old' AS data_source, CASE grp WHEN 'bonafide' THEN 'human_likely' WHEN 'replay' THEN 'uncertain' ELSE 'ai_likely' END AS origin_label,
  CASE grp WHEN 'replay' THEN 'replayed_or_re_recorded' ELSE 'clean_original' END AS manipulation_label, CASE grp WHEN 'conversion' THEN 'voice_conversion' ELSE grp END AS attack_hint,
  CASE grp WHEN 'bonafide' THEN 'low' ELSE 'high' END AS risk_level, CASE grp WHEN 'replay' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS sample_weight,
  CASE grp WHEN 'replay' THEN 'old_replay_origin_masked' ELSE 'old_' || grp || '_base' END AS weight_reason, CASE grp WHEN 'replay' THEN 'false' ELSE 'true' END AS use_origin_loss FROM g WHERE grp IS NOT NULL
UNION ALL SELECT 'new_' || CAST(row_id AS VARCHAR), 'phase7c1', origin_label, manipulation_label, attack_hint, risk_level, round(least(4.0::DOUBLE, greatest(0.1::DOUBLE, base + coalesce(bonus, 0))), 4),
  why || CASE WHEN bonus IS NULL THEN '' ELSE '+baseline_' || status_raw END, 'true' FROM w""")
def training_schema(spark, sf):
    g = c("grp")
    old = I.manifest(spark, sf).withColumn("grp", L.attack_group(c("label"), c("attack_type"))).where(g.isNotNull()).select(
        F.concat(F.lit("old_"), c("doc_id").cast("string")).alias("sample_id"), F.lit("old").alias("data_source"),
        F.when(g == "bonafide", "human_likely").when(g == "replay", "uncertain").otherwise("ai_likely").alias("origin_label"),
        F.when(g == "replay", "replayed_or_re_recorded").otherwise("clean_original").alias("manipulation_label"),
        F.when(g == "conversion", "voice_conversion").otherwise(g).alias("attack_hint"),
        F.when(g == "bonafide", "low").otherwise("high").alias("risk_level"),
        F.when(g == "replay", 0.7).otherwise(1.0).alias("sample_weight"),
        F.when(g == "replay", "old_replay_origin_masked").otherwise(F.concat(F.lit("old_"), g, F.lit("_base"))).alias("weight_reason"),
        F.when(g == "replay", "false").otherwise("true").alias("use_origin_loss"))
    none = F.lit(None).cast("string")
    lab = L.forensic_labels(c("manip_raw"), c("gt_origin"), c("gt_manip"), c("status_raw"),
                            F.when(c("p1") >= 0.7, "FAKE").otherwise("REAL"), c("hint_raw"), c("p1"), c("p2"), none, none, none)
    w, why = L.collection_weight(c("manip_raw"), c("gt_origin"), c("status_raw"))
    new = I.raw_labels(spark, sf).select(
        F.concat(F.lit("new_"), c("row_id").cast("string")).alias("sample_id"), F.lit("phase7c1").alias("data_source"),
        *[lab[k].alias(k) for k in ("origin_label", "manipulation_label", "attack_hint", "risk_level")],
        w.alias("sample_weight"), why.alias("weight_reason"), F.lit("true").alias("use_origin_loss"))
    return old.unionByName(new)


VARIANT_VALUES = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in L.VARIANT_ROWS)
SUFFIXES = ["clean", "direct", "replay_laptop_mobile", "mixer_processed", "fabricated", "strange"]


@query("p40_variant_labels", f"""{R}, v AS (SELECT row_id, CASE WHEN group_no % 2 = 0 THEN 'Human' ELSE 'ai' END AS prefix, {I._sql_list(SUFFIXES)}[1 + row_id % 6] AS suffix, p1 * 40 AS dur FROM r),
i AS (SELECT row_id, dur, CASE WHEN suffix = 'clean' AND lower(prefix) = 'human' THEN 'human_clean' WHEN suffix = 'direct' AND prefix = 'ai' THEN 'ai_direct'
  WHEN suffix IN ('replay_laptop_mobile', 'mixer_processed', 'fabricated') THEN lower(prefix) || '_' || suffix END AS variant_id FROM v)
SELECT i.row_id, i.variant_id, t.* EXCLUDE (variant_id), CASE WHEN t.manipulation_type = 'partial_ai_insert' THEN NULL WHEN dur < 8 THEN 'needs_review' ELSE 'approved' END AS review_status
FROM i LEFT JOIN (VALUES {VARIANT_VALUES}) t({', '.join(L.VARIANT_COLUMNS)}) ON t.variant_id = i.variant_id""")
def variant_labels(spark, sf):
    prefix = F.when(c("group_no") % 2 == 0, "Human").otherwise("ai")
    rows = I.raw_labels(spark, sf).select("row_id", (c("p1") * 40).alias("dur"), L.variant_id(prefix, I._pick(SUFFIXES, "row_id")).alias("variant_id"))
    rules = spark.createDataFrame(L.VARIANT_ROWS, L.VARIANT_COLUMNS)  # eight fixed rows
    return rows.join(F.broadcast(rules), "variant_id", "left").withColumn("review_status", F.when(
        c("manipulation_type") == "partial_ai_insert", F.lit(None).cast("string")).when(c("dur") < 8, "needs_review")
        .otherwise("approved")).drop("dur")


@query("p41_region_check", f"""WITH f AS ({I.FILES_SQL}), x AS (SELECT file_id, region_start - (file_id % 7 = 0)::INT * 5 AS s, region_end - (file_id % 11 = 0)::INT * 6 AS e, duration_sec - (file_id % 3) * 2 AS d FROM f)
SELECT file_id, CASE WHEN s < 0 THEN 'negative_start' WHEN e <= s THEN 'end_not_after_start' WHEN s >= d THEN 'start_past_duration' WHEN e > d THEN 'end_past_duration' END AS problem FROM x""")
def region_check(spark, sf):
    k = c("file_id")
    s = c("region_start") - F.when(k % 7 == 0, 5).otherwise(0)
    e = c("region_end") - F.when(k % 11 == 0, 6).otherwise(0)
    return I.files(spark, sf).select("file_id", L.region_problem(s, e, c("duration_sec") - (k % 3) * 2).alias("problem"))


@query("p42_expected_risk", f"""{LABEL_SQL}, e AS (SELECT row_id, {RISK_SQL} AS rr FROM n) SELECT row_id, rr[1] AS expected_risk, rr[2] AS expected_role FROM e""")
def expected_risk(spark, sf):
    out = L.expected_risk(c("manip_raw"), c("gt_origin"), c("gt_manip"), F.lit(None).cast("boolean"))
    return I.raw_labels(spark, sf).select("row_id", out["risk"].alias("expected_risk"), out["role"].alias("expected_role"))


@query("p43_expected_category", f"""{R}, t AS (SELECT row_id, lower(replace(path_raw, chr(92), '/')) AS t FROM r), n AS (SELECT *, list_extract(string_split(t, '/'), -1) AS n FROM t)
SELECT row_id, CASE WHEN starts_with(n, 'bad_short') THEN 'bad_audio_short' WHEN contains(t, 'fabricated') AND contains(t, 'ai') THEN 'ai_fabricated' WHEN contains(t, 'fabricated') AND contains(t, 'human') THEN 'human_fabricated'
  WHEN contains(t, 'human_clean') THEN 'human_direct' WHEN contains(t, 'ai_replay') OR contains(t, 'ai_repeat') THEN 'ai_replay' WHEN contains(t, 'human_replay') OR contains(t, 'human_repeat') THEN 'human_replay'
  WHEN contains(t, 'ai_mixer') THEN 'ai_mixer' WHEN contains(t, 'human_mixer') THEN 'human_mixer'
  WHEN contains(t, 'mixer') OR contains(t, 'channel') THEN CASE WHEN contains(t, 'human') THEN 'human_mixer' WHEN contains(t, 'ai') THEN 'ai_mixer' ELSE 'mixer_channel' END
  WHEN contains(t, 'replay') OR contains(t, 'repeat') OR contains(t, 'rerecord') THEN CASE WHEN contains(t, 'human') THEN 'human_replay' WHEN contains(t, 'ai') THEN 'ai_replay' ELSE 'replay' END
  WHEN regexp_matches(t, 'ai[^/]*direct') THEN 'ai_direct' WHEN regexp_matches(t, 'human[^/]*direct') THEN 'human_direct'
  WHEN contains(n, 'direct') AND regexp_matches(t, '\\bai\\b') THEN 'ai_direct' WHEN contains(n, 'direct') AND regexp_matches(t, '\\bhuman\\b') THEN 'human_direct' ELSE 'unknown' END AS category FROM n""")
def expected_category(spark, sf):
    return I.raw_labels(spark, sf).select("row_id", T.expected_category(c("path_raw")).alias("category"))
