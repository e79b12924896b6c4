"""Hand-made tables: ties, nulls, one class, empty inputs, touching intervals, odd durations."""

import math

import pytest
from pyspark.sql import functions as F

from echotrail.functions import rules
from echotrail.functions import numbers as N
from echotrail.operators import cascade, intervals, localize, metrics, profile, quality, ranges, sampling, segments, timeline
from echotrail.operators import skew
from echotrail.operators.joins import checked_join
from echotrail.sources import readers, sinks
from echotrail.streaming.ingest import ingest


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def scored(spark, data):
    return spark.createDataFrame([("k", float(s), y) for s, y in data], "k string, s double, y int")


def roc(df):
    r = ranges.ranking_metrics(df, ["k"], "s", "y").first()
    return r["roc_auc"], r["average_precision"], r["eer"]


def test_ranking_metrics_on_ties_and_single_class(spark):
    assert roc(scored(spark, [(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)])) == (0.5, 0.5, 0.5)
    assert roc(scored(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)])) == (1.0, 1.0, 0.0)
    assert roc(scored(spark, [(0.9, 1), (0.8, 1)])) == (None, None, None)


def test_threshold_on_the_score_counts_as_positive(spark):
    df = scored(spark, [(k / 100, k % 2) for k in range(0, 101)])
    grid = metrics.threshold_counts(df, ["k"], "s", "y", 1, 99, 1).collect()
    assert len(grid) == 99
    for r in grid:
        assert r["tp"] + r["fp"] == 101 - r["threshold_pct"]


def test_calibration_edges(spark):
    # 0.3 belongs to the bin that starts at 3 * 0.1, which is larger than 0.3; 1.0 to the last bin
    df = scored(spark, [(0.3, 1), (1.0, 1), (0.25, 0)])
    r = metrics.calibration_error(df, ["k"], "s", "y").first()
    assert r["ece"] == pytest.approx(abs(0.275 - 0.5) * 2 / 3)


def test_empty_scope_keeps_a_row(spark):
    df = spark.createDataFrame([("a", 1, 1)], "scope string, y int, p int")
    out = {r["scope"]: r for r in metrics.metric_rows(df, "scope", "y", "p", ["a", "none"]).collect()}
    assert out["none"]["n"] == 0 and out["none"]["accuracy"] is None
    assert out["a"]["balanced_accuracy"] is None and out["a"]["f1"] == 1.0


@pytest.mark.parametrize("duration,length,hop,count", [
    (0.0, 4.0, 2.0, 0), (3.0, 4.0, 2.0, 1), (4.0, 4.0, 2.0, 1), (5.0, 4.0, 2.0, 2), (10.0, 2.0, 5.0, 2), (9.0, 4.0, 0.0, 3)])
def test_window_counts(spark, duration, length, hop, count):
    df = spark.createDataFrame([(duration,)], "d double")
    out = segments.hop_windows(df, "d", length, hop).collect()
    assert len(out) == count
    if out:
        assert max(r["end_sec"] for r in out) <= duration


def test_touching_intervals_do_not_overlap(spark):
    seg = spark.createDataFrame([("f", "a", 0.0, 4.0), ("f", "b", 4.0, 8.0), ("g", "c", 0.0, 4.0)], "file_id string, segment_id string, start_sec double, end_sec double")
    ann = spark.createDataFrame([("f", 4.0, 6.0), ("f", 3.0, 3.0), ("f", 5.0, 7.0)], "file_id string, ann_start double, ann_end double")
    out = {r["segment_id"]: r for r in intervals.label_segments(seg, ann, "file_id", "segment_id", 0.5).collect()}
    assert out["a"]["segment_label"] == "outside_fabricated_region" and out["a"]["max_overlap_sec"] is None
    assert out["b"]["max_overlap_sec"] == 2.0 and out["b"]["total_overlap_sec"] == 4.0 and out["b"]["overlaps_region"]
    assert out["c"]["segment_label"] == "unknown_no_timestamp"


def test_overlap_pairs_over_many_cells(spark):
    seg = spark.createDataFrame([("f", i, float(i), float(i) + 130.0) for i in range(0, 400, 7)], "file_id string, segment_id int, start_sec double, end_sec double")
    ann = spark.createDataFrame([("f", float(a), float(a) + 90.0) for a in range(0, 500, 45)], "file_id string, ann_start double, ann_end double")
    got = intervals.overlap_pairs(seg, ann, "file_id").count()
    s, a = seg.collect(), ann.collect()
    assert got == sum(x["start_sec"] < y["ann_end"] and x["end_sec"] > y["ann_start"] for x in s for y in a)


def test_regions_merge_over_small_gaps_and_contained_chunks(spark):
    data = [(0.0, 10.0), (2.0, 3.0), (10.01, 11.0), (11.02, 12.0), (11.5, 13.0)]
    df = spark.createDataFrame([("s", i, a, b, 0.7, True, "x", None) for i, (a, b) in enumerate(data)],
                               "sample_id string, chunk_id int, start_time double, end_time double, spoof_probability double, evaluated boolean, attack_type string, attack_probs string")
    out = sorted((r["start_time"], r["end_time"], r["chunk_count"]) for r in timeline.suspicious_regions(df).collect())
    assert out == [(0.0, 11.0, 3), (11.02, 13.0, 2)]


def test_constant_features_have_no_robust_z(spark):
    df = spark.createDataFrame([("f", float(i), "s%d" % i, 1.0, float(i)) for i in range(4)], "file string, start_sec double, seg string, a double, b double")
    out = localize.with_medians(df, ["file"], ["a", "b"])
    assert [r[0] for r in out.select(localize.robust_z("a")).collect()] == [None] * 4
    assert all(r[0] is not None for r in out.select(localize.robust_z("b")).collect())


def test_single_segment_recording_is_insufficient(spark):
    df = spark.createDataFrame([("f", "s", 0.0, 4.0, 1.0, 2.0)], "file string, seg string, start_sec double, end_sec double, a double, b double")
    out = localize.localization_candidates(df, "file", "seg", {"acoustic": ["a"], "ssl": ["b"]}, F.lit(False), F.lit(True))
    assert out.first()["candidate_type"] == "insufficient_data"


def test_number_parsing(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("",), ("abc",), ("NaN",), ("inf",), (None,)], "x string")
    assert [r[0] for r in df.select(N.to_number(F.col("x"))).collect()] == [1.5, 2.0, None, None, None, None, None]


def test_clean_branch_with_unknown_axis_stays_inconclusive(spark):
    df = spark.createDataFrame([("low", "unknown", "low", "low"), ("low", "low", "low", "not_evaluated")], "origin string, replay string, mixer string, partial string")
    out = rules.fuse_axes({a: F.col(a) for a in rules.AXES})
    assert [r[0] for r in df.select(out["experimental_fusion_status"]).collect()] == [
        "inconclusive_manual_review_experimental", "accept_human_clean_experimental"]


def test_checked_join_refuses_changed_counts(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError):
        checked_join(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], "gap")
    with pytest.raises(ValueError):
        checked_join(left, spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string"), ["k"], "repeat")


def hot_table(spark):
    data = [("hot", i % 37, i) for i in range(300)] + [(f"k{i % 40}", i % 5, i) for i in range(300, 900)] + [(None, 1, 900), (None, 2, 901)]
    return spark.createDataFrame(data, "k string, v int, id int").repartition(7).withColumn("v", F.when(F.col("v") != 3, F.col("v").cast("double")))


OPS = {
    "running": lambda d: skew.running(d, ["k"], ["v", "id"], {"s": ("sum", F.col("id")), "m": ("max", F.col("v")), "lo": ("min", F.col("id"))}),
    "exclusive": lambda d: skew.running(d, ["k"], ["v", "id"], {"s": ("sum", F.col("id")), "m": ("max", F.col("v"))}, exclusive=True),
    "numbered": lambda d: skew.numbered(d, ["k"], [F.col("v").desc_nulls_last(), "id"]),
    "quantiles": lambda d: skew.exact_quantiles(d, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}),
    "medians": lambda d: skew.group_medians(d, ["k"], ["v", "id"], "m_"),
    "percent": lambda d: skew.percent_rank_average(d, ["k"], "v", "p"),
    "minrank": lambda d: skew.min_rank_descending(d, ["k"], "v", "r"),
    "neighbours": lambda d: skew.neighbours(d, ["k"], ["v", "id"], "id", 2, "a", "b"),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_split_and_plain_paths_agree(spark, name):
    rounded = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in d.dtypes])
    plain = rows(rounded(OPS[name](hot_table(spark))))
    spark.conf.set(skew.HOT_ROWS_KEY, "40")
    try:
        split = rows(rounded(OPS[name](hot_table(spark))))
    finally:
        spark.conf.unset(skew.HOT_ROWS_KEY)
    assert plain == split


def test_hot_limit_does_not_grow_with_the_table(spark):
    spark.conf.set(skew.HOT_ROWS_KEY, "2")
    try:
        df = spark.range(5000).select((F.col("id") % 1000).alias("k"))
        assert skew.hot_groups(df, ["k"]).count() == 1000
        assert skew.hot_groups(df.where("k = id"), ["k"]) is None
        mixed = df.where("k < 10 OR id < 1000")
        cold, big = skew.halves(mixed, ["k"])
        assert big.count() == 50 and cold.count() == 990
        assert rows(skew.numbered(mixed.withColumn("v", F.lit(1)), ["k"], [F.col("v")]).groupBy("k").agg(F.max("position"))) == rows(
            mixed.groupBy("k").count())
    finally:
        spark.conf.unset(skew.HOT_ROWS_KEY)


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a = rows(sampling.sample_per_group(df.repartition(3), ["g"], "id", 20, 9))
    b = rows(sampling.sample_per_group(df.repartition(11), ["g"], "id", 20, 9))
    assert a == b and len(a) == 60
    assert a != rows(sampling.sample_per_group(df, ["g"], "id", 20, 10))


def test_speaker_split_is_disjoint_with_floor_counts(spark):
    df = spark.range(1003).select(F.concat(F.lit("s"), (F.col("id") % 103).cast("string")).alias("speaker"), F.lit("LA").alias("dataset"), F.lit("spoof").alias("label"))
    out = sampling.speaker_split(df, "speaker", ["dataset", "label"], 1)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 82, "val": 10, "test": 11}
    assert out.select("speaker").distinct().count() == 103


def test_folds_keep_groups_whole(spark):
    df = spark.range(1000).select((F.col("id") % 90).alias("g"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    folds = sampling.group_folds(df, "g", "y", 5, 3)
    assert folds.count() == 90
    assert sampling.spread_groups(df.join(folds, "g"), "g", "fold").count() == 0


def test_feature_leakage_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "rms_mean double, file_category double, fusion_score double")
    out = {r["column"]: r["status"] for r in quality.feature_leakage(df, ["rms_mean", "fusion_score"]).collect()}
    assert out == {"rms_mean": "absent", "file_category": "present_as_metadata_ok", "fusion_score": "forbidden_as_feature"}


def test_append_is_idempotent_and_stream_equals_batch(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    target = str(tmp_path / "t")
    sinks.append_new(df.where("id < 30"), "id", target)
    sinks.append_new(df, "id", target)
    assert rows(sinks.append_new(df, "id", target)) == rows(df)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.where("id < 25").write.mode("append").parquet(src)
    ingest(spark, src, df.schema, "id", out, state)
    df.where("id >= 20").write.mode("append").parquet(src)
    assert rows(ingest(spark, src, df.schema, "id", out, state)) == rows(df)


def test_annotation_formats(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.jsonl")
    sinks.write_csv(spark.createDataFrame([("x.wav", "1", "2")], "Filename string, insert_start_sec string, insert_end_sec string"), a)
    spark.createDataFrame([("7", "3", "4")], "id string, start_sec string, end_sec string").write.json(b)
    out = readers.read_annotations(spark, [a, b], "id string, start_sec string, end_sec string")
    assert sorted((r["audio_path"] or "", r["file_id"] or "", r["start"], r["end"]) for r in out.collect()) == [("", "7", "3", "4"), ("x.wav", "", "1", "2")]


def test_cascade_profile_of_missing_scores(spark):
    df = spark.createDataFrame([("f", "a", 0.0, None, 1), ("f", "b", 2.0, 0.95, 1), ("g", "c", 0.0, 0.2, 0)], "file_id string, segment_id string, start_sec double, prob double, y int")
    p = {r["file_id"]: r for r in cascade.segment_profile(df, "file_id", "prob", ["start_sec", "segment_id"], [0.9], 5, "y").collect()}
    assert p["f"]["high_90"] == 1 and p["f"]["topk_minus_rest"] == pytest.approx(0.475) and p["f"]["top1_hit"]
    assert not p["g"]["top5_hit"]


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", "z")], "k string, v string")
    assert rows(profile.mode_per_group(df, ["k"], "v", "m")) == [("a", "x"), ("b", "z")]


def test_csv_headers_in_another_order_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file_id,label\n1,real\n")
    (tmp_path / "b.csv").write_text("label,file_id\nfake,2\n")
    for read in (lambda p: readers.read_csv_text(spark, p), lambda p: readers.read_csv(spark, p, "file_id string, label string")):
        assert read(str(tmp_path / "a.csv")).collect()[0].asDict() == {"file_id": "1", "label": "real"}
        with pytest.raises(Exception, match="header"):
            read(str(tmp_path)).collect()


def test_csv_line_breaks_and_blanks_round_trip(spark, tmp_path):
    path = str(tmp_path / "notes.csv")
    df = spark.createDataFrame([("1", 'two\nlines, "quoted"'), ("2", ""), ("3", None)], "id string, note string")
    sinks.write_csv(df, path)
    assert rows(readers.read_csv_text(spark, path, multi_line=True, keep_blank=True)) == rows(df)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.read_csv(spark, path, "id int, note string").collect()


def test_append_keeps_the_first_row_and_lets_errors_out(spark, tmp_path):
    path = str(tmp_path / "target")
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "id int, name string, at int")
    for _ in range(2):
        out = sinks.append_new(df, "id", path, order=["at"])
    assert rows(out) == rows(df.where("name <> 'b'"))
    other = str(tmp_path / "other")
    df.drop("id").write.parquet(other)
    with pytest.raises(Exception, match="id"):
        sinks.append_new(df, "id", other)


def test_a_missing_score_never_clears_a_recording(spark):
    df = spark.createDataFrame(
        [(None, None, None), (None, "REAL", None), (None, "fake ", None), (0.1, "FAKE", None), (0.1, "REAL", "yes")],
        "decision_score double, prediction string, partial_fabrication_binary string").selectExpr(
        "*", "'clean_direct' AS manipulation_type", "'human' AS ground_truth_origin", "cast(null AS double) AS max_chunk_spoof",
        "cast(null AS double) AS suspicious_chunk_ratio", "1.0D AS suspicious_start_time", "2.0D AS suspicious_end_time",
        "false AS partial_region_detected", "cast(null AS string) AS error")
    got = [r["s"] for r in df.select(rules.baseline_status().alias("s")).collect()]
    assert got == ["borderline_needs_review", "clean_human_accepted", "clean_human_false_alarm", "clean_human_accepted",
                   "partial_fabrication_missed"]


def test_folds_follow_the_smallest_class(spark):
    df = spark.createDataFrame([(i, int(i < 4)) for i in range(20)], "g int, y int")
    assert sampling.folds_to_use(df, "y", 5) == 4
    with pytest.raises(ValueError, match="too few"):
        sampling.folds_to_use(df.where("g >= 2"), "y", 5)


def test_csv_folder_of_differing_headers(spark, tmp_path):
    path = tmp_path / "a folder"
    path.mkdir()
    (path / "1.csv").write_text("file_id,label\n1,real\n2,\n")
    (path / "2.csv").write_text('label,"note, long",file_id\nfake,"a ""b""",3\n')
    (path / "3.csv").write_text("file_id,label\n4,fake\n")
    (path / "4.csv").write_text("")
    got = readers.read_csv_folder(spark, str(path))
    assert sorted(got.columns) == ["file_id", "label", "note, long"]
    assert rows(got.select("file_id", "label", "`note, long`")) == [
        ("1", "real", None), ("2", None, None), ("3", "fake", 'a "b"'), ("4", "fake", None)]
    (path / "5.csv").write_text("file_id,FILE_ID\n1,2\n")
    with pytest.raises(ValueError, match="repeated column"):
        readers.read_csv_folder(spark, str(path))
    with pytest.raises(ValueError, match="no CSV header"):
        empty = tmp_path / "none.csv"
        empty.write_text("")
        readers.read_csv_folder(spark, str(empty))


def test_annotation_folder_of_differing_headers(spark, tmp_path):
    path = tmp_path / "marks.csv"
    path.mkdir()
    (path / "1.csv").write_text("file_id,start_sec,end_sec\n1,0.5,1\n")
    (path / "2.csv").write_text("insert_end_sec,id,insert_start_sec\n4,2,3\n")
    got = readers.read_annotations(spark, [str(path)], "")
    assert rows(got.select("file_id", "start", "end")) == [("1", "0.5", "1"), ("2", "3", "4")]
