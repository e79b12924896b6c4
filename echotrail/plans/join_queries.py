"""Joins, matching, overlap audits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import text as T
from echotrail.operators import joins as J
from echotrail.operators import setops as U
from echotrail.operators.metrics import best_row
from echotrail.operators.skew import join_ids
from echotrail.plans import inputs as I
from echotrail.plans.metric_queries import rounded
from echotrail.plans.projection_queries import STEM
from echotrail.plans.registry import query

c = F.col
FIL = f"WITH f AS ({I.FILES_SQL})"
SEG = f"{FIL}, g AS ({I.SEGMENTS_SQL})"
MAN = f"WITH m AS ({I.MANIFEST_SQL})"


@query("j1_checked_join", f"{FIL} SELECT f.*, c_mktsegment FROM f JOIN customer ON c_custkey = speaker_id")
def checked_join(spark, sf):
    cust = I.table(spark, sf, "customer").select(c("c_custkey").alias("speaker_id"), "c_mktsegment", F.lit("x").alias("dataset"))
    return J.checked_join(I.files(spark, sf), cust, ["speaker_id"], "speakers")


@query("j2_left_new_columns", f"""{FIL}, s AS (SELECT l_orderkey AS file_id, count(*) AS n_segments, max(l_quantity) AS max_quantity FROM lineitem GROUP BY 1) SELECT f.file_id, f.dataset, n_segments, max_quantity FROM f LEFT JOIN s USING (file_id)""")
def left_new_columns(spark, sf):
    s = I.segments(spark, sf).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max("f_quantity").alias("max_quantity"),
                                                     F.first(F.lit("x")).alias("dataset"))
    return J.add_columns(I.files(spark, sf).select("file_id", "dataset"), s, ["file_id"])


THREE = f"WITH b AS ({I.RESULTS_SQL['baseline']}), p AS ({I.RESULTS_SQL['product']}), l AS ({I.RESULTS_SQL['loss']})"


def three_models(spark, sf):
    """The three model variants side by side, columns suffixed by variant."""
    out = None
    for v in I.VARIANTS:
        t = J.prefixed(I.model_results(spark, sf, v), v)
        out = t if out is None else join_ids(out, t, ["sample_id"])
    return out


@query("j3_three_way_join", f"{THREE} SELECT sample_id, b.decision_score AS decision_score_baseline, p.decision_score AS decision_score_product, l.decision_score AS decision_score_loss, b.prediction AS prediction_baseline, p.prediction AS prediction_product FROM b JOIN p USING (sample_id) JOIN l USING (sample_id)")
def three_way_join(spark, sf):
    return three_models(spark, sf).select("sample_id", "decision_score_baseline", "decision_score_product", "decision_score_loss",
                                          "prediction_baseline", "prediction_product")


@query("j4_segment_tables", f"""{SEG}, i AS (SELECT file_id, segment_id, CASE WHEN y_true = 1 THEN 'inside' ELSE '' END AS label, f_price AS price FROM g), n AS (SELECT file_id, segment_id, 'late' AS label, f_tax AS tax FROM g WHERE start_sec >= 6)
SELECT g.file_id, g.segment_id, coalesce(nullif(CASE WHEN g.f_tax > 0.04 THEN 'taxed' ELSE '' END, ''), nullif(i.label, ''), n.label) AS label, price, tax FROM g LEFT JOIN i ON i.file_id = g.file_id AND i.segment_id = g.segment_id LEFT JOIN n ON n.file_id = g.file_id AND n.segment_id = g.segment_id""")
def segment_tables(spark, sf):
    s = I.segments(spark, sf)
    keys = ["file_id", "segment_id"]
    base = s.select(*keys, F.when(c("f_tax") > 0.04, "taxed").otherwise("").alias("label"))
    inside = s.select(*keys, F.when(c("y_true") == 1, "inside").otherwise("").alias("label_io"), c("f_price").alias("price"))
    near = s.where(c("start_sec") >= 6).select(*keys, F.lit("late").alias("label_ng"), c("f_tax").alias("tax"))
    out = J.coalesce_suffix(join_ids(base, inside, keys, "left"), "io")
    out = J.coalesce_suffix(join_ids(out, near, keys, "left"), "ng")
    return out.withColumn("label", T.not_blank(c("label")))


# Feature set whose model speaks for an axis; each axis has its own.
AXIS_FEATURES = {"origin": "ssl", "replay": "acoustic", "mixer": "ssl"}
AXIS_SQL = ", ".join(f"avg(prob) FILTER (task_name = '{a}_file_model' AND feature_set = '{k}') AS {a}_p" for a, k in AXIS_FEATURES.items())
AXES = f"""o AS (SELECT file_id, {AXIS_SQL} FROM ({I.PREDICTIONS_SQL}) GROUP BY file_id),
pa AS (SELECT file_id, max(prob) AS partial_p FROM g GROUP BY file_id)"""


def axis_tables(spark, sf, features=AXIS_FEATURES):
    """Mean probability per file and task, by each axis's feature set, and the strongest segment per file."""
    # the three file models share one scan and one shuffle
    axes = {"file_models": I.predictions(spark, sf).groupBy("file_id").agg(*[
        F.avg(F.when((c("task_name") == f"{a}_file_model") & (c("feature_set") == k), c("prob"))).alias(f"{a}_p") for a, k in features.items()])}
    axes["partial"] = I.segments(spark, sf).groupBy("file_id").agg(F.max("prob").alias("partial_p"))
    return axes


@query("j5_axis_star_join", f"{SEG}, {AXES} SELECT f.file_id, f.dataset, round(origin_p, 6) AS origin_p, round(replay_p, 6) AS replay_p, round(mixer_p, 6) AS mixer_p, round(partial_p, 6) AS partial_p FROM f LEFT JOIN o USING (file_id) LEFT JOIN pa USING (file_id)")
def axis_star_join(spark, sf):
    return rounded(star(spark, sf).select("file_id", "dataset", "origin_p", "replay_p", "mixer_p", "partial_p"))


def star(spark, sf):
    out = I.files(spark, sf)
    for t in axis_tables(spark, sf).values():
        out = join_ids(out, t, ["file_id"], "left")
    return out


@query("j6_first_dimension_row", f"""{SEG} SELECT g.file_id, g.segment_id, d.o_orderkey AS lookup_file, d.o_totalprice FROM g JOIN f USING (file_id) LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) d ON d.o_custkey = f.speaker_id""")
def first_dimension_row(spark, sf):
    s = join_ids(I.segments(spark, sf).select("file_id", "segment_id"), I.files(spark, sf).select("file_id", "speaker_id"), ["file_id"])
    dim = I.table(spark, sf, "orders").select(c("o_custkey").alias("speaker_id"), c("o_orderkey").alias("lookup_file"), "o_totalprice")
    return J.lookup_first(s, dim, ["speaker_id"], [c("o_totalprice").desc(), c("lookup_file").asc()]).drop("speaker_id")


@query("j7_semi_join", f"{SEG} SELECT file_id, segment_id FROM g WHERE file_id IN (SELECT file_id FROM f WHERE file_category IN ('ai_fabricated', 'human_fabricated'))")
def semi_join(spark, sf):
    partial = I.files(spark, sf).where(c("file_category").isin("ai_fabricated", "human_fabricated")).select("file_id")
    return I.segments(spark, sf).select("file_id", "segment_id").join(partial, "file_id", "left_semi")


@query("j8_anti_join", f"{FIL} SELECT file_id FROM f WHERE file_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join(spark, sf):
    done = I.segments(spark, sf).where(c("y_true") == 1).select("file_id")
    return I.files(spark, sf).select("file_id").join(done, "file_id", "left_anti")


ANN = f"""{MAN}, fl AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) AS file_id, filepath AS audio_path FROM m WHERE domain <> 'attic'),
a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'doc' || CAST(doc_id AS VARCHAR) ELSE '' END AS file_id, CASE doc_id % 5 WHEN 1 THEN upper(filepath) WHEN 2 THEN '/elsewhere/item_' || CAST(doc_id % 900 AS VARCHAR) || '.wav'
  WHEN 3 THEN 'x/ITEM ' || CAST(doc_id % 900 AS VARCHAR) || '.mp3' ELSE 'nowhere_' || CAST(doc_id AS VARCHAR) || '.wav' END AS audio_path, doc_id % 7 <> 3 AS usable FROM m)"""
NKEY = "trim(regexp_replace(lower({s}), '[^a-z0-9_]+', '_', 'g'), '_')"


def annotation_inputs(spark, sf):
    m = I.manifest(spark, sf)
    d = c("doc_id")
    files = m.where(c("domain") != "attic").select(F.concat(F.lit("doc"), d.cast("string")).alias("file_id"), c("filepath").alias("audio_path"))
    item = (d % 900).cast("string")
    path = (F.when(d % 5 == 1, F.upper("filepath")).when(d % 5 == 2, F.concat(F.lit("/elsewhere/item_"), item, F.lit(".wav")))
            .when(d % 5 == 3, F.concat(F.lit("x/ITEM "), item, F.lit(".mp3"))).otherwise(F.concat(F.lit("nowhere_"), d.cast("string"), F.lit(".wav"))))
    ann = m.select("doc_id", F.when(d % 5 == 0, F.concat(F.lit("doc"), d.cast("string"))).otherwise("").alias("file_id"), path.alias("audio_path"), (d % 7 != 3).alias("usable"))
    return ann, files


@query("j9_match_by_levels", f"""{ANN}, k AS (SELECT file_id, audio_path, unnest([{{'l': 1, 'k': file_id}}, {{'l': 2, 'k': lower(audio_path)}}, {{'l': 3, 'k': lower(list_extract(string_split(audio_path, '/'), -1))}}, {{'l': 4, 'k': {NKEY.format(s=STEM.format(c='audio_path'))}}}]) AS k FROM fl),
w AS (SELECT doc_id, unnest([{{'l': 1, 'k': file_id}}, {{'l': 2, 'k': lower(audio_path)}}, {{'l': 3, 'k': lower(list_extract(string_split(audio_path, '/'), -1))}}, {{'l': 4, 'k': {NKEY.format(s=STEM.format(c='audio_path'))}}}]) AS k FROM a WHERE usable),
h AS (SELECT w.doc_id, w.k.l AS lv, k.file_id, k.audio_path FROM w JOIN k ON w.k.l = k.k.l AND w.k.k = k.k.k WHERE w.k.k <> ''), b AS (SELECT * FROM h QUALIFY lv = min(lv) OVER (PARTITION BY doc_id)), n AS (SELECT doc_id, count(*) AS c, max(file_id) AS fid, max(audio_path) AS ap FROM b GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN NOT usable THEN 'invalid' WHEN c IS NULL THEN 'unmatched_file' WHEN c = 1 THEN 'matched' ELSE 'ambiguous_match' END AS annotation_status, CASE WHEN c = 1 THEN fid END AS matched_file_id, CASE WHEN c = 1 THEN ap END AS matched_audio_path FROM a LEFT JOIN n USING (doc_id)""")
def match_by_levels(spark, sf):
    ann, files = annotation_inputs(spark, sf)
    return J.match_by_levels(ann, files, "doc_id")


@query("j10_match_by_any_key", f"""{ANN}, k AS (SELECT file_id, unnest([lower(audio_path), lower(list_extract(string_split(audio_path, '/'), -1)), lower({STEM.format(c='audio_path')}), lower(file_id)]) AS k FROM fl),
w AS (SELECT doc_id, unnest([lower(audio_path), lower(list_extract(string_split(audio_path, '/'), -1)), lower({STEM.format(c='audio_path')})]) AS k FROM a WHERE usable), n AS (SELECT doc_id, count(DISTINCT file_id) AS c, min(file_id) AS fid FROM w JOIN k USING (k) GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN NOT usable THEN 'invalid_time_range' WHEN c IS NULL THEN 'unmatched' WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END AS match_status, CASE WHEN c = 1 THEN fid END AS matched_file_id FROM a LEFT JOIN n USING (doc_id)""")
def match_by_any_key(spark, sf):
    ann, files = annotation_inputs(spark, sf)
    return J.match_by_any_key(ann, files, "doc_id", "audio_path")


HOLD = f"{MAN}, h AS (SELECT '/other/item_' || CAST(item_id * 17 AS VARCHAR) || '.wav' AS path, 'ITEM_' || CAST(item_id * 3 AS VARCHAR) AS id FROM benchmark)"


def holdout_keys(spark, sf):
    i = c("item_id")
    return I.table(spark, sf, "benchmark").select(F.concat(F.lit("/other/item_"), (i * 17).cast("string"), F.lit(".wav")).alias("path"),
                                                  F.concat(F.lit("ITEM_"), (i * 3).cast("string")).alias("id"))


@query("j16_holdout_overlap", f"""{HOLD} SELECT doc_id, filepath, split FROM m WHERE lower(filepath) IN (SELECT lower(path) FROM h) OR lower(file_id) || '.wav' IN (SELECT list_extract(string_split(path, '/'), -1) FROM h) OR lower(file_id) IN (SELECT lower(id) FROM h)""")
def holdout_overlap(spark, sf):
    out = J.flag_seen(I.manifest(spark, sf), "filepath", holdout_keys(spark, sf), "path", "hit", ids=("file_id", "id"), stems=False)
    return out.where("hit").select("doc_id", "filepath", "split")


@query("j17_split_overlap", f"""{MAN}, k AS (SELECT file_id, max(split = 'train') AS tr, max(split = 'val') AS va, max(split = 'test') AS te FROM m GROUP BY file_id), h AS (SELECT 'train' AS a, 'val' AS b, file_id FROM k WHERE tr AND va UNION ALL SELECT 'train', 'test', file_id FROM k WHERE tr AND te UNION ALL SELECT 'val', 'test', file_id FROM k WHERE va AND te)
SELECT v.a AS split_a, v.b AS split_b, count(file_id) OVER (PARTITION BY v.a, v.b) AS overlap_count, CASE WHEN count(file_id) OVER (PARTITION BY v.a, v.b) > 0 THEN 'high' ELSE 'none' END AS severity, file_id AS shared_key FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(a, b) LEFT JOIN h ON h.a = v.a AND h.b = v.b""")
def split_overlap(spark, sf):
    return J.split_overlap(I.manifest(spark, sf), "file_id", "split", ["train", "val", "test"])


@query("j18_overlap_status", f"""{HOLD}, t AS (SELECT DISTINCT file_id FROM m WHERE split = 'train'), s AS (SELECT * FROM m WHERE split <> 'train')
SELECT s.doc_id, CASE WHEN file_id IN (SELECT file_id FROM t) THEN 'seen_in_p5_training' WHEN file_id IN (SELECT regexp_extract(path, '([^/]+)\\.wav$', 1) FROM h) THEN 'seen_in_p5c_controlled' WHEN duration IS NOT NULL THEN 'independent_holdout' ELSE 'unknown_overlap_status' END AS overlap_status FROM s""")
def overlap_status(spark, sf):
    m = I.manifest(spark, sf)
    rows = m.where(c("split") != "train")
    rows = J.flag_seen(rows, "filepath", m.where(c("split") == "train").select("filepath"), "filepath", "_train")
    rows = J.flag_seen(rows, "filepath", holdout_keys(spark, sf), "path", "_controlled")
    return rows.select("doc_id", F.when(c("_train"), "seen_in_p5_training").when(c("_controlled"), "seen_in_p5c_controlled")
                       .when(c("duration").isNotNull(), "independent_holdout").otherwise("unknown_overlap_status").alias("overlap_status"))


@query("j19_split_by_path", f"""{MAN}, l AS (SELECT lower(filepath) AS np, split || CAST(doc_id % 3 AS VARCHAR) AS sp, doc_id FROM m WHERE domain <> 'phone' QUALIFY row_number() OVER (PARTITION BY lower(filepath) ORDER BY doc_id DESC) = 1) SELECT m.doc_id, coalesce(sp, '') AS leakage_safe_split FROM m LEFT JOIN l ON np = lower(m.filepath)""")
def split_by_path(spark, sf):
    m = I.manifest(spark, sf)
    look = m.where(c("domain") != "phone").select(F.upper("filepath").alias("p"), F.concat("split", (c("doc_id") % 3).cast("string")).alias("leakage_safe_split"), "doc_id")
    return J.attach_by_path(m.select("doc_id", "filepath"), "filepath", look, "p", "leakage_safe_split", "doc_id").drop("filepath")


@query("j20_positional_join", """WITH p AS (SELECT p_brand AS scope, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
a AS (SELECT p_brand AS scope, 'clip_' || CAST(p_partkey * 7 % 1009 AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 7 % 1009, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_partkey % 40 <> 1 OR p_brand <> 'Brand#3')
SELECT p.scope, CAST(p.rn AS BIGINT) AS position, p_partkey, name FROM p JOIN a ON p.scope = a.scope AND p.rn = a.rn AND p.n = a.n""")
def positional_join(spark, sf):
    part = I.table(spark, sf, "part").select(c("p_brand").alias("scope"), "p_partkey")
    name = F.concat(F.lit("clip_"), (c("p_partkey") * 7 % 1009).cast("string"), F.lit("_"), c("p_partkey").cast("string"))
    # one brand has fewer names than rows and must stay unpaired
    names = part.where((c("p_partkey") % 40 != 1) | (c("scope") != "Brand#3")).select("scope", name.alias("name"))
    return J.positional_join(part, names, "scope", [c("p_partkey").asc()], [J.natural_key(c("name")).asc()])


@query("j21_enriched_timestamps", f"""{FIL}, m AS (SELECT file_id, region_start + 100 AS s FROM f WHERE file_id % 2 = 0) SELECT f.file_id, coalesce(f.region_start, CASE WHEN f.file_id % 2 = 0 THEN 1.5::DOUBLE END) AS timestamp_start FROM f""")
def enriched_timestamps(spark, sf):
    f = I.files(spark, sf)
    known = f.where(c("file_id") % 2 == 0).select("file_id", F.lit(1.5).alias("manifest_start"))
    j = join_ids(f.select("file_id", "region_start"), best_row(known, ["file_id"], [c("manifest_start").asc()]), ["file_id"], "left")
    return j.select("file_id", F.coalesce("region_start", "manifest_start").alias("timestamp_start"))


@query("j22_model_comparison", f"""{THREE}, d AS (SELECT sample_id, error FROM l WHERE sample_id % 3 <> 0) SELECT b.manipulation_type, count(*) AS n, count(*) FILTER (p.sample_id IS NULL) AS missing_product, count(*) FILTER (d.sample_id IS NULL) AS missing_decision FROM b LEFT JOIN (SELECT * FROM p WHERE decision_score < 0.9) p USING (sample_id) LEFT JOIN d ON d.sample_id = b.sample_id GROUP BY 1""")
def model_comparison(spark, sf):
    b = I.model_results(spark, sf).select("sample_id", "manipulation_type")
    p = I.model_results(spark, sf, "product").where(c("decision_score") < 0.9).select("sample_id", c("prediction").alias("pp"))
    d = I.model_results(spark, sf, "loss").where(c("sample_id") % 3 != 0).select("sample_id", F.lit(1).alias("dd"))
    j = join_ids(join_ids(b, p, ["sample_id"], "left"), d, ["sample_id"], "left")
    return j.groupBy("manipulation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("pp").isNull()).alias("missing_product"),
                                              F.count_if(c("dd").isNull()).alias("missing_decision"))


@query("j23_foreign_keys", "SELECT o_orderkey AS file_id, 'file_without_segments' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'segment_without_file' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def foreign_keys(spark, sf):
    return J.missing_keys(I.files(spark, sf), I.segments(spark, sf), "file_id", "file_without_segments", "segment_without_file")


@query("j24_id_consistency", f"{FIL} SELECT file_id, 'only_files' AS side FROM f WHERE file_category <> 'ai_mixer' AND file_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') UNION ALL SELECT DISTINCT l_orderkey, 'only_segments' FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey NOT IN (SELECT file_id FROM f WHERE file_category <> 'ai_mixer')")
def id_consistency(spark, sf):
    a = I.files(spark, sf).where(c("file_category") != "ai_mixer")
    b = I.table(spark, sf, "lineitem").where(c("l_linestatus") == "F").select(c("l_orderkey").alias("file_id"))
    return J.missing_keys(a, b, "file_id", "only_files", "only_segments")


@query("j25_feature_index", """WITH u AS (SELECT doc_id, coalesce(vec_id, -1) AS spectrogram_idx, CASE WHEN p.page_id IS NULL THEN -1 ELSE p.page_id END AS environmental_idx FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN pages p ON p.page_id * 2 = doc_id)
SELECT CASE WHEN spectrogram_idx >= 0 AND environmental_idx >= 0 THEN 'both' WHEN spectrogram_idx >= 0 THEN 'spectrogram' WHEN environmental_idx >= 0 THEN 'environmental' ELSE 'none' END AS features, count(*) AS n, CAST(sum(spectrogram_idx) AS BIGINT) AS spectrogram_sum FROM u GROUP BY 1""")
def feature_index(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id")
    a = I.table(spark, sf, "embeddings").select(c("vec_id").alias("doc_id"), c("vec_id").alias("spectrogram_idx"))
    b = I.table(spark, sf, "pages").select((c("page_id") * 2).alias("doc_id"), c("page_id").alias("environmental_idx"))
    u = join_ids(join_ids(docs, a, ["doc_id"], "left"), b, ["doc_id"], "left").na.fill(-1, ["spectrogram_idx", "environmental_idx"])
    s, e = c("spectrogram_idx") >= 0, c("environmental_idx") >= 0
    return u.groupBy(F.when(s & e, "both").when(s, "spectrogram").when(e, "environmental").otherwise("none").alias("features")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("spectrogram_idx").alias("spectrogram_sum"))


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("j26_missing_variants", f"""WITH w AS (SELECT DISTINCT p_size AS base_id, t AS v FROM part, unnest({I._sql_list(KINDS)}) u(t)), h AS (SELECT DISTINCT p_size, p_type FROM part WHERE p_brand < 'Brand#13')
SELECT base_id, string_agg(v, ', ' ORDER BY v) AS missing_variants FROM w LEFT JOIN h ON p_size = base_id AND p_type = v WHERE p_size IS NULL AND base_id IN (SELECT p_size FROM h) GROUP BY base_id""")
def missing_variants(spark, sf):
    have = I.table(spark, sf, "part").where(c("p_brand") < "Brand#13").select(c("p_size").alias("base_id"), c("p_type").alias("variant_id"))
    return J.missing_combinations(have, "base_id", "variant_id", KINDS)


# Set operations ------------------------------------------------------------------------

UN = f"""{MAN}, b AS (SELECT * FROM m WHERE dataset <> 'RealWorld'), r AS (SELECT *, CASE WHEN domain = 'studio' AND doc_id % 5 = 0 THEN 'synthetic' ELSE domain END AS dom2, CASE WHEN doc_id % 2 = 0 THEN 'youtube' ELSE source END AS src2 FROM m WHERE dataset = 'RealWorld')"""
UNB = "SELECT filepath, CASE WHEN label IN ('bonafide', 'spoof') THEN label END AS label, CASE WHEN dataset IN ('LA', 'DF', 'PA') THEN dataset END AS dataset, attack_type, 'studio' AS domain, speaker_id, 'clean' AS source, CAST(NULL AS DOUBLE) AS duration, file_id FROM b"
UNR = """SELECT filepath, CASE WHEN d = 'synthetic' THEN 'spoof' ELSE 'bonafide' END AS label, 'RealWorld' AS dataset, CASE WHEN d = 'synthetic' THEN 'synthesis' ELSE 'bonafide' END AS attack_type, d AS domain, speaker_id, CASE WHEN src2 IN ('public_dataset', 'youtube', 'synthetic', 'realworld') THEN 'realworld' END AS source, duration, CAST(NULL AS VARCHAR) AS file_id
FROM (SELECT *, CASE WHEN dom2 IN ('read_speech', 'studio', 'broadcast', 'podcast', 'social', 'phone', 'synthetic') THEN dom2 ELSE 'unknown' END AS d FROM r)"""


def two_sources(spark, sf):
    m = I.manifest(spark, sf)
    d = c("doc_id")
    b = m.where(c("dataset") != "RealWorld").drop("duration")
    r = (m.where(c("dataset") == "RealWorld").drop("file_id")
         .withColumn("domain", F.when((c("domain") == "studio") & (d % 5 == 0), "synthetic").otherwise(c("domain")))
         .withColumn("source", F.when(d % 2 == 0, "youtube").otherwise(c("source"))))
    return b, r


@query("u1_union_manifests", f"{UN} {UNB} UNION ALL {UNR}")
def union_manifests(spark, sf):
    b, r = two_sources(spark, sf)
    return U.union_aligned(U.standard_benchmark(b), U.standard_realworld(r))


@query("u2_standard_sources", f"{UN}, u AS ({UNB} UNION ALL {UNR}) SELECT dataset, domain, label, source, count(*) AS n FROM u GROUP BY ALL")
def standard_sources(spark, sf):
    b, r = two_sources(spark, sf)
    return U.union_aligned(U.standard_benchmark(b), U.standard_realworld(r)).groupBy("dataset", "domain", "label", "source").agg(F.count(F.lit(1)).alias("n"))


@query("u3_intersection", f"{MAN} SELECT file_id FROM m WHERE split = 'train' INTERSECT SELECT file_id FROM m WHERE split = 'val'")
def intersection(spark, sf):
    m = I.manifest(spark, sf)
    return m.where(c("split") == "train").select("file_id").intersect(m.where(c("split") == "val").select("file_id"))


@query("u4_difference", f"{MAN} SELECT file_id FROM m WHERE split = 'train' EXCEPT SELECT file_id FROM m WHERE split = 'val'")
def difference(spark, sf):
    m = I.manifest(spark, sf)
    return m.where(c("split") == "train").select("file_id").subtract(m.where(c("split") == "val").select("file_id"))


@query("u5_first_per_key", f"{MAN} SELECT file_id, doc_id, filepath FROM m QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY doc_id) = 1")
def first_per_key(spark, sf):
    # min over a struct keeps one row per key without sorting a group
    best = I.manifest(spark, sf).groupBy("file_id").agg(F.min(F.struct("doc_id", "filepath")).alias("b"))
    return best.select("file_id", "b.doc_id", "b.filepath")


@query("u6_repeated_rows", f"{MAN} SELECT doc_id, file_id, split FROM m QUALIFY count(*) OVER (PARTITION BY file_id, split) > 1")
def repeated_rows(spark, sf):
    return U.repeated_rows(I.manifest(spark, sf), ["file_id", "split"]).select("doc_id", "file_id", "split")
