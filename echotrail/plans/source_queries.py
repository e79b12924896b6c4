"""Scans and sinks: tables are written by Spark to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.operators.columns import guess_columns
from echotrail.operators.skew import join_ids
from echotrail.plans import inputs as I
from echotrail.plans.registry import query
from echotrail.session import scratch_path
from echotrail.sources import readers as S
from echotrail.sources import sinks as K
from echotrail.streaming.ingest import ingest

c = F.col
FIL = f"WITH f AS ({I.FILES_SQL})"
MAN = f"WITH m AS ({I.MANIFEST_SQL})"


@query("s1_csv_typed", f"{FIL} SELECT file_id, audio_path, gate_prob, duration_sec, region_start FROM f")
def csv_typed(spark, sf):
    path = scratch_path(spark, "typed") + ".csv"
    K.write_csv(I.files(spark, sf).select("file_id", "audio_path", "gate_prob", "duration_sec", "region_start"), path)
    return S.read_csv(spark, path, "file_id bigint, audio_path string, gate_prob double, duration_sec double, region_start double")


@query("s2_csv_text", f"WITH r AS ({I.RAW_SQL}) SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(trim(labels_raw), '') AS labels_raw, nullif(trim(number_raw), '') AS number_raw, nullif(trim(hint_raw), '') AS hint_raw FROM r")
def csv_text(spark, sf):
    path = scratch_path(spark, "text") + ".csv"
    K.write_csv(I.raw_labels(spark, sf).select("row_id", "labels_raw", "number_raw", "hint_raw"), path)
    return S.read_csv_text(spark, path)


@query("s2_csv_mixed_headers", f"WITH r AS ({I.RAW_SQL}) SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(trim(labels_raw), '') AS labels_raw, CASE WHEN row_id % 3 = 1 THEN nullif(trim(hint_raw), '') END AS hint_raw, CASE WHEN row_id % 3 <> 2 THEN nullif(trim(number_raw), '') END AS number_raw FROM r")
def csv_mixed_headers(spark, sf):
    r = I.raw_labels(spark, sf)
    path = scratch_path(spark, "mixed")
    # three layouts in one folder: two orders of columns, one column more, one less
    for k, names in enumerate((["row_id", "labels_raw", "number_raw"], ["number_raw", "hint_raw", "row_id", "labels_raw"], ["labels_raw", "row_id"])):
        r.where(c("row_id") % 3 == k).select(*names).write.mode("append").option("header", True).option("escape", '"').csv(path)
    return S.read_csv_folder(spark, path).select("row_id", "labels_raw", "hint_raw", "number_raw")


@query("s3_pruned_scan", "SELECT l_orderkey AS file_id, l_discount AS score FROM lineitem")
def pruned_scan(spark, sf):
    return I.table(spark, sf, "lineitem").select(c("l_orderkey").alias("file_id"), c("l_discount").alias("score"))


@query("s4_out_of_core_counts", "SELECT l_shipdate < TIMESTAMP '1998-01-01' AS early, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def out_of_core_counts(spark, sf):
    li = I.table(spark, sf, "lineitem")
    return li.groupBy((c("l_shipdate") < F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")).alias("early"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("s5_json_lists", f"{FIL}, {'''a AS (SELECT file_id, region_start AS s, region_end AS e FROM f WHERE region_end IS NOT NULL UNION ALL SELECT file_id, region_end + 1, region_end + 2 FROM f WHERE region_end IS NOT NULL)'''} SELECT CAST(file_id AS VARCHAR) AS file_id, s AS start_sec, e AS end_sec FROM a")
def json_lists(spark, sf):
    f = I.files(spark, sf).where(c("region_end").isNotNull())
    item = lambda a, b: F.struct(a.alias("start_sec"), b.alias("end_sec"))
    doc = f.select(c("file_id").cast("string").alias("file_id"), F.array(
        item(c("region_start"), c("region_end")), item(c("region_end") + 1, c("region_end") + 2)).alias("regions"))
    path = scratch_path(spark, "lists") + ".jsonl"
    doc.write.mode("overwrite").json(path)
    read = S.read_json(spark, path, "file_id string, regions array<struct<start_sec:double,end_sec:double>>", lines=True)
    return S.explode_list(read, "regions", ["file_id"])


@query("s6_mixed_annotations", f"{FIL} SELECT CASE WHEN file_id % 2 = 0 THEN 'csv' ELSE 'jsonl' END AS format, CAST(file_id AS VARCHAR) AS file_id, audio_path, CAST(region_start AS VARCHAR) AS \"start\", CAST(region_end AS VARCHAR) AS \"end\", CASE WHEN file_id % 2 = 0 THEN 'fake' END AS label FROM f WHERE region_end IS NOT NULL")
def mixed_annotations(spark, sf):
    f = I.files(spark, sf).where(c("region_end").isNotNull())
    base = scratch_path(spark, "annotations")
    K.write_csv(f.where(c("file_id") % 2 == 0).select(c("file_id").alias("ID"), c("audio_path").alias("Output_File"), c("region_start").alias("insert_start_sec"),
                                                      c("region_end").alias("insert_end_sec"), F.lit("fake").alias("label")), base + ".csv")
    f.where(c("file_id") % 2 == 1).select("file_id", "audio_path", c("region_start").cast("string").alias("start_sec"), c("region_end").cast("string").alias("end_sec")).write.json(base + ".jsonl")
    out = S.read_annotations(spark, [base + ".csv", base + ".jsonl"], "file_id string, audio_path string, start_sec string, end_sec string")
    return out.select(F.regexp_extract("source_annotation_file", r"\.(\w+)$", 1).alias("format"), "file_id", "audio_path", "start", "end", "label")


@query("s7_fallback_columns", f"WITH r AS ({I.RAW_SQL}) SELECT row_id, coalesce(nullif(trim(hint_raw), ''), nullif(trim(origin_raw), ''), nullif(trim(stem_raw), '')) AS output_file FROM r")
def fallback_columns(spark, sf):
    r = I.raw_labels(spark, sf)
    return r.select("row_id", S.first_present(r, ["no_such_column", "hint_raw", "origin_raw", "stem_raw"]).alias("output_file"))


@query("s8_detected_columns", f"{FIL} SELECT audio_path, CAST(file_id AS VARCHAR) AS file_id, CAST(region_start AS VARCHAR) AS \"start\", CAST(region_end AS VARCHAR) AS \"end\", CAST(NULL AS VARCHAR) AS label FROM f")
def detected_columns(spark, sf):
    f = I.files(spark, sf).select(c("audio_path").alias("FileName"), c("file_id").alias("Id"), c("region_start").alias("Suspicious_Start_Sec"), c("region_end").alias("END_SEC"), "gate_prob")
    assert guess_columns(f.columns, S.ANNOTATION_COLUMNS)["end"] == "END_SEC"
    return S.map_annotations(f, "table").drop("source_annotation_file")


@query("s9_trial_lines", """SELECT 'SPK_' || CAST(o_custkey AS VARCHAR) AS speaker_id, 'F_' || CAST(o_orderkey AS VARCHAR) AS file_id, CASE WHEN o_orderstatus = 'F' THEN 'bonafide' ELSE 'spoof' END AS label, 'LA' AS dataset, CASE WHEN o_orderstatus = 'F' THEN 'bonafide' ELSE 'synthesis' END AS attack_type FROM orders WHERE o_orderkey % 50 <> 7""")
def trial_lines(spark, sf):
    o = I.table(spark, sf, "orders")
    label = F.when(c("o_orderstatus") == "F", "bonafide").otherwise("spoof")
    head = F.concat(F.lit("SPK_"), c("o_custkey").cast("string"), F.lit("  F_"), c("o_orderkey").cast("string"))
    # every fiftieth line is cut short, as broken trial lists are
    line = F.when(c("o_orderkey") % 50 == 7, head).otherwise(F.concat(head, F.lit(" - A01 \t - "), label, F.lit(" ")))
    path = scratch_path(spark, "trials")
    o.select(line.alias("value")).write.mode("overwrite").text(path)
    return S.read_trials(spark, path, "LA", "synthesis")


@query("s11_written_rows", f"{MAN} SELECT 'a' AS kind, CAST(doc_id AS VARCHAR) AS doc_id, label, NULL::VARCHAR AS domain FROM m UNION ALL SELECT 'b', CAST(doc_id AS VARCHAR), NULL, domain FROM m")
def written_rows(spark, sf):
    m = I.manifest(spark, sf)
    path = scratch_path(spark, "rows") + ".csv"
    K.write_rows([m.select(F.lit("a").alias("kind"), "doc_id", "label"), m.select(F.lit("b").alias("kind"), "doc_id", "domain")], path)
    return S.read_csv_text(spark, path, keep_blank=True)


@query("s12_append_resume", f"{FIL} SELECT file_id, gate_prob FROM f")
def append_resume(spark, sf):
    f = I.files(spark, sf).select("file_id", "gate_prob")
    path = scratch_path(spark, "resume")
    K.append_new(f.where(c("file_id") % 3 != 0), "file_id", path)
    K.append_new(f.where(c("file_id") % 2 == 0), "file_id", path)
    return K.append_new(f, "file_id", path)


@query("s12_stream_ingest", f"{FIL} SELECT file_id, gate_prob FROM f")
def stream_ingest(spark, sf):
    f = I.files(spark, sf).select("file_id", "gate_prob")
    base = scratch_path(spark, "stream")
    f.where(c("file_id") % 2 == 0).write.mode("append").parquet(base + "/in")
    ingest(spark, base + "/in", f.schema, "file_id", base + "/out", base + "/state")
    # the second arrival repeats part of the first
    f.where((c("file_id") % 2 == 1) | (c("file_id") % 3 == 0)).write.mode("append").parquet(base + "/in")
    return ingest(spark, base + "/in", f.schema, "file_id", base + "/out", base + "/state")


@query("s13_split_folders", f"{MAN} SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM m GROUP BY split")
def split_folders(spark, sf):
    path = scratch_path(spark, "splits")
    K.write_split(I.manifest(spark, sf).select("doc_id", "split"), "split", path)
    parts = None
    for s in ("train", "val", "test"):
        t = spark.read.parquet(f"{path}/split={s}").select(F.lit(s).alias("split"), "doc_id")
        parts = t if parts is None else parts.unionByName(t)
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def clip_folder(spark, sf):
    """Documents as text files, one folder per language and source."""
    path = scratch_path(spark, "clips")
    I.table(spark, sf, "documents").select(F.concat_ws("_", F.lit("lang"), "lang").alias("lang_dir"), F.concat_ws("_", F.lit("set"), "source").alias("set_dir"), F.base64(F.encode("text", "utf-8")).alias("line")) \
        .repartition("lang_dir", "set_dir").write.partitionBy("lang_dir", "set_dir").text(path)
    return path


def folder_of(path_col="path"):
    return (F.regexp_extract(path_col, "lang_dir=lang_([^/]+)", 1).alias("lang"), F.regexp_extract(path_col, "set_dir=set_([^/]+)", 1).alias("source"))


@query("s10_directory_listing", "SELECT lang, source, true AS has_size, 'bonafide' AS label FROM documents GROUP BY ALL")
def directory_listing(spark, sf):
    m = S.manifest_from_listing(S.list_files(spark, clip_folder(spark, sf), "*.txt"))
    return m.select(*folder_of("filepath"), (c("size_bytes") > 0).alias("has_size"), F.lit("bonafide").alias("label")).distinct()


@query("s14_hashed_files", "SELECT lang, source, 64 AS hash_length, true AS sized FROM documents GROUP BY ALL")
def hashed_files(spark, sf):
    h = S.hashed_files(spark, clip_folder(spark, sf), "*.txt")
    return h.select(*folder_of(), F.length("sha256").alias("hash_length"), (c("size_bytes") > 0).alias("sized")).distinct()


@query("s15_asset_registry", """WITH d AS (SELECT DISTINCT lang, source FROM documents), s AS (SELECT lang, source, lang = 'en' AS required FROM d UNION ALL SELECT 'xx', source, source = 'src1' FROM d WHERE lang = 'en')
SELECT s.lang, s.source, CASE WHEN d.lang IS NULL THEN 'missing' ELSE 'present' END AS action, CASE WHEN d.lang IS NOT NULL THEN 'none' WHEN required THEN 'error' ELSE 'warning' END AS severity FROM s LEFT JOIN d ON d.lang = s.lang AND d.source = s.source""")
def asset_registry(spark, sf):
    d = I.table(spark, sf, "documents").select("lang", "source").distinct()
    spec = d.withColumn("required", c("lang") == "en").unionByName(
        d.where(c("lang") == "en").select(F.lit("xx").alias("lang"), "source", (c("source") == "src1").alias("required")))
    have = S.hashed_files(spark, clip_folder(spark, sf), "*.txt").select(*folder_of(), "sha256")
    one = have.groupBy("lang", "source").agg(F.max("sha256").alias("sha256"))
    keyed = lambda t: t.withColumn("asset_id", F.concat_ws("/", "lang", "source"))
    return S.check_registry(keyed(spec), keyed(one).select("asset_id", "sha256"), "asset_id").select("lang", "source", "action", "severity")


@query("j27_files_on_storage", """SELECT DISTINCT 'xx' AS lang, source FROM documents WHERE lang = 'en'""")
def files_on_storage(spark, sf):
    d = I.table(spark, sf, "documents").select("lang", "source").distinct()
    want = d.unionByName(d.where(c("lang") == "en").select(F.lit("xx").alias("lang"), "source"))
    have = S.list_files(spark, clip_folder(spark, sf), "*.txt").select(*folder_of())
    return want.join(have.distinct(), ["lang", "source"], "left_anti")
