"""Cutting recordings, interval overlap and chunk timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.operators import intervals as V
from echotrail.operators import segments as S
from echotrail.operators import timeline as T
from echotrail.operators.skew import join_ids, top_rows
from echotrail.plans import inputs as I
from echotrail.plans.metric_queries import rounded
from echotrail.plans.registry import query

c = F.col
FIL = f"WITH f AS ({I.FILES_SQL})"
SEG = f"{FIL}, g AS ({I.SEGMENTS_SQL})"


@query("g1_hop_windows", f"""{FIL}, w AS (SELECT file_id, duration_sec AS d, unnest(range(0, greatest(1, ceil((duration_sec - 4) / 2.5::DOUBLE) + 1)::BIGINT)) AS segment_index FROM f WHERE duration_sec > 0)
SELECT file_id, segment_index, round(segment_index * 2.5::DOUBLE, 6) AS start_sec, round(least(segment_index * 2.5::DOUBLE + 4, d), 6) AS end_sec,
  round(least(segment_index * 2.5::DOUBLE + 4, d) - segment_index * 2.5::DOUBLE, 6) AS segment_duration_sec FROM w WHERE segment_index * 2.5::DOUBLE < d""")
def hop_windows(spark, sf):
    df = I.files(spark, sf).select("file_id", "duration_sec")
    return S.hop_windows(df, "duration_sec", 4.0, 2.5).drop("duration_sec")


@query("g2_sample_windows", f"""{FIL}, n AS (SELECT file_id, CAST(duration_sec * 16000 AS BIGINT) AS n FROM f), w AS (SELECT file_id, n, CASE WHEN n / 16000 <= 4 THEN 1 ELSE greatest(1, ceil((n - 64000) / 32000::DOUBLE) + 1) END::BIGINT AS k FROM n),
u AS (SELECT file_id, n, unnest(range(0, k)) AS i FROM w)
SELECT file_id, 'seg_' || lpad(CAST(i AS VARCHAR), 4, '0') AS segment_id, i * 32000 AS sample_start, least(i * 32000 + 64000, n) AS sample_end,
  round(i * 32000 / 16000::DOUBLE, 4) AS start_sec, round(least(i * 32000 + 64000, n) / 16000::DOUBLE, 4) AS end_sec FROM u""")
def sample_windows(spark, sf):
    df = I.files(spark, sf).select("file_id", (c("duration_sec") * 16000).cast("long").alias("n"), F.lit(16000).alias("sr"))
    return S.sample_windows(df, "n", "sr").select("file_id", "segment_id", "sample_start", "sample_end", "start_sec", "end_sec")


@query("g3_full_windows", f"""{FIL}, n AS (SELECT file_id, CAST(duration_sec * 16000 AS BIGINT) AS n FROM f), u AS (SELECT file_id, n, unnest(range(0, CASE WHEN n <= 64000 THEN 1 ELSE (n - 64000) // 48000 + 1 END)) AS i FROM n)
SELECT file_id, CASE WHEN n <= 64000 THEN 0 ELSE i * 48000 / 16000 END::DOUBLE AS start_sec, CASE WHEN n <= 64000 THEN n / 16000 ELSE (i * 48000 + 64000) / 16000 END::DOUBLE AS end_sec FROM u""")
def full_windows(spark, sf):
    df = I.files(spark, sf).select("file_id", (c("duration_sec") * 16000).cast("long").alias("n"), F.lit(16000).alias("sr"))
    return S.full_windows(df, "n", "sr").select("file_id", "start_sec", "end_sec")


@query("g4_window_starts", f"""{FIL}, n AS (SELECT file_id, CAST(duration_sec * 16000 AS BIGINT) AS n, region_start AS rs, region_end AS re FROM f),
s AS (SELECT file_id, CASE WHEN n <= 64600 THEN [0] ELSE list_concat(range(0, n - 64600 + 1, 32300), [n - 64600],
   CASE WHEN re > rs THEN [greatest(0, least(CAST(floor((rs + re) / 2 * 16000) AS BIGINT) - 32300, n - 64600)), greatest(0, least(CAST(floor(rs * 16000) AS BIGINT), n - 64600))] ELSE [] END) END AS l FROM n)
SELECT DISTINCT file_id, unnest(l)::BIGINT AS start_sample FROM s""")
def window_starts(spark, sf):
    df = I.files(spark, sf).withColumn("n", (c("duration_sec") * 16000).cast("long"))
    return S.window_starts(df, "n", 64600, 32300, 16000, "region_start", "region_end").select("file_id", "start_sample")


@query("g5_training_windows", f"""{FIL}, b AS (SELECT file_id, duration_sec AS d, region_start AS rs, region_end AS re, file_category IN ('ai_fabricated', 'human_fabricated') AS par, dataset = 'O' AS old FROM f),
w AS (SELECT file_id, unnest(CASE WHEN par AND re > rs THEN [{{'s': 'partial_suspicious_region', 'a': greatest(0, (rs + re) / 2 - 2.0375::DOUBLE), 'b': greatest(0, (rs + re) / 2 - 2.0375::DOUBLE) + 4.075::DOUBLE}}] WHEN par THEN []
  WHEN old THEN [{{'s': 'old_first_window', 'a': 0::DOUBLE, 'b': least(4.075::DOUBLE, d)}}] WHEN d <= 4.075::DOUBLE THEN [{{'s': 'phase7c1_start_only', 'a': 0::DOUBLE, 'b': least(4.075::DOUBLE, d)}}]
  ELSE [{{'s': 'phase7c1_start', 'a': 0::DOUBLE, 'b': 4.075::DOUBLE}}, {{'s': 'phase7c1_middle', 'a': (d - 4.075::DOUBLE) / 2, 'b': (d - 4.075::DOUBLE) / 2 + 4.075::DOUBLE}}, {{'s': 'phase7c1_end', 'a': d - 4.075::DOUBLE, 'b': d - 4.075::DOUBLE + 4.075::DOUBLE}}] END) AS w FROM b)
SELECT file_id, w.s AS window_strategy, round(w.a, 4) AS window_start_time, round(w.b, 4) AS window_end_time FROM w""")
def training_windows(spark, sf):
    df = I.files(spark, sf).withColumn("source", F.when(c("dataset") == "O", "old").otherwise("new"))
    partial = c("file_category").isin("ai_fabricated", "human_fabricated")
    out = S.training_windows(df, "duration_sec", "source", partial, "region_start", "region_end", 4.075)
    return out.select("file_id", "window_strategy", "window_start_time", "window_end_time")


@query("g6_clamped_windows", f"""{FIL}, b AS (SELECT file_id, duration_sec AS d, greatest(0, duration_sec - 5 + file_id % 3) AS s FROM f)
SELECT file_id, CASE WHEN s + 4 > d THEN greatest(0, d - 4) ELSE s END AS window_start, CASE WHEN s + 4 > d THEN d ELSE s + 4 END AS window_end, CASE WHEN s + 4 > d OR d < 4 THEN 'tail_clamped' ELSE 'tail' END AS window_strategy FROM b""")
def clamped_windows(spark, sf):
    start = c("duration_sec") - 5 + c("file_id") % 3
    out = S.clamp_window(start, c("duration_sec"), 4.0, F.lit("tail"))
    return I.files(spark, sf).select("file_id", *[v.alias(k) for k, v in out.items()])


@query("p38_insertion_segments", f"""{FIL}, b AS (SELECT file_id, duration_sec AS d, region_start AS rs, region_end AS re, file_category IN ('ai_fabricated', 'human_fabricated') AND region_end > region_start AS val, file_category NOT IN ('ai_fabricated', 'human_fabricated') AS whole FROM f),
w AS (SELECT file_id, unnest(CASE WHEN val THEN [{{'i': '_pre_real', 'a': 0::DOUBLE, 'b': rs, 'l': 'pre_real_segment', 'o': 'human_likely', 'r': 'low'}}, {{'i': '_inserted_ai', 'a': rs, 'b': re, 'l': 'inserted_ai_segment', 'o': 'ai_likely', 'r': 'high'}},
   {{'i': '_post_real', 'a': re, 'b': d, 'l': 'post_real_segment', 'o': 'human_likely', 'r': 'low'}}] WHEN whole THEN [{{'i': '_full', 'a': 0::DOUBLE, 'b': d, 'l': 'full_file_clean', 'o': 'human_likely', 'r': 'low'}}] END) AS w FROM b)
SELECT file_id, CAST(file_id AS VARCHAR) || w.i AS segment_id, w.a AS segment_start_time, w.b AS segment_end_time, w.l AS segment_label, w.o AS segment_origin_label, w.r AS segment_risk_level FROM w""")
def insertion_segments(spark, sf):
    partial = c("file_category").isin("ai_fabricated", "human_fabricated")
    valid = partial & F.coalesce(c("region_end") > c("region_start"), F.lit(False))
    return S.insertion_segments(I.files(spark, sf), "file_id", "duration_sec", "region_start", "region_end", valid, ~partial)


# Interval overlap ----------------------------------------------------------------------

ANN_SQL = """a AS (SELECT file_id, region_start AS ann_start, region_end AS ann_end FROM f WHERE region_end IS NOT NULL
  UNION ALL SELECT file_id, region_end + 1, region_end + 2.5::DOUBLE FROM f WHERE region_end IS NOT NULL AND file_id % 3 = 0)"""


def annotations(spark, sf):
    f = I.files(spark, sf).where(c("region_end").isNotNull())
    second = F.when(c("file_id") % 3 == 0, F.struct((c("region_end") + 1).alias("ann_start"), (c("region_end") + 2.5).alias("ann_end")))
    return f.select("file_id", F.explode(F.filter(F.array(
        F.struct(c("region_start").alias("ann_start"), c("region_end").alias("ann_end")), second), lambda x: x.isNotNull())).alias("a")).select("file_id", "a.*")


LABEL_SQL = f"""{SEG}, {ANN_SQL}, o AS (SELECT g.file_id, g.segment_id, max(least(end_sec, ann_end) - greatest(start_sec, ann_start)) AS mx, sum(least(end_sec, ann_end) - greatest(start_sec, ann_start)) AS tot
  FROM g JOIN a ON g.file_id = a.file_id AND start_sec < ann_end AND end_sec > ann_start GROUP BY ALL),
lab AS (SELECT g.*, mx AS max_overlap_sec, mx / (end_sec - start_sec) AS max_overlap_ratio, tot AS total_overlap_sec, k.file_id IS NOT NULL AS known FROM g LEFT JOIN o ON o.file_id = g.file_id AND o.segment_id = g.segment_id LEFT JOIN (SELECT DISTINCT file_id FROM a) k ON k.file_id = g.file_id)"""


@query("j11_overlap_labels", f"""{LABEL_SQL} SELECT file_id, segment_id, max_overlap_sec, round(max_overlap_ratio, 6) AS max_overlap_ratio, round(total_overlap_sec, 6) AS total_overlap_sec,
  known AND coalesce(max_overlap_ratio >= 0.5, false) AS overlaps_region, CASE WHEN NOT known THEN 'unknown_no_timestamp' WHEN max_overlap_ratio >= 0.5 THEN 'fabricated_region' ELSE 'outside_fabricated_region' END AS segment_label,
  known AS training_label_available FROM lab""")
def overlap_labels(spark, sf):
    seg = I.segments(spark, sf).select("file_id", "segment_id", "start_sec", "end_sec")
    return rounded(V.label_segments(seg, annotations(spark, sf), "file_id", "segment_id", 0.5).drop("start_sec", "end_sec"))


def with_region(spark, sf):
    r = I.files(spark, sf).where(c("region_end").isNotNull()).select("file_id", "region_start", "region_end", "file_category")
    return join_ids(I.segments(spark, sf), r, ["file_id"])


REG = f"{SEG}, r AS (SELECT g.*, region_start AS fs, region_end AS fe, file_category FROM g JOIN f USING (file_id) WHERE region_end IS NOT NULL)"
OV = "greatest(0::DOUBLE, least(end_sec, fe) - greatest(start_sec, fs))"
REGION_LABEL = f"CASE WHEN {OV} / 4 >= 0.5 THEN 'inside_fabricated_region' WHEN {OV} > 0 THEN 'boundary_overlap' ELSE 'outside_fabricated_region' END"


@query("j12_region_label", f"""{REG} SELECT file_id, segment_id, round({OV}, 4) AS overlap_sec, round({OV} / 4, 4) AS overlap_ratio, {REGION_LABEL} AS region_label FROM r""")
def region_label(spark, sf):
    out = V.overlap_label(c("start_sec"), c("end_sec"), c("region_start"), c("region_end"), 0.5)
    return with_region(spark, sf).select("file_id", "segment_id", *[v.alias(k) for k, v in out.items()])


@query("j13_region_distance", f"""{REG} SELECT file_id, segment_id, round(CASE WHEN (start_sec + end_sec) / 2 BETWEEN fs AND fe THEN 0 WHEN (start_sec + end_sec) / 2 < fs THEN fs - (start_sec + end_sec) / 2 ELSE (start_sec + end_sec) / 2 - fe END::DOUBLE, 4) AS distance FROM r""")
def region_distance(spark, sf):
    return with_region(spark, sf).select("file_id", "segment_id", V.distance_to_region(
        c("start_sec"), c("end_sec"), c("region_start"), c("region_end")).alias("distance"))


@query("j14_overlap_flag", f"""{SEG} SELECT g.file_id, segment_id, coalesce(start_sec < region_end AND end_sec > region_start, false) AS overlaps FROM g JOIN f USING (file_id)""")
def overlap_flag(spark, sf):
    j = join_ids(I.segments(spark, sf).select("file_id", "segment_id", "start_sec", "end_sec"),
                  I.files(spark, sf).select("file_id", "region_start", "region_end"), ["file_id"])
    return j.select("file_id", "segment_id", V.overlaps(c("start_sec"), c("end_sec"), c("region_start"), c("region_end")).alias("overlaps"))


@query("j15_boundary_segments", f"""{REG}, k AS (SELECT *, lead(prob) OVER w AS lower, lag(prob) OVER w AS higher FROM r WINDOW w AS (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id)),
n AS (SELECT k.*, b.t, b.kind FROM k, LATERAL (VALUES ('start_boundary', fs), ('end_boundary', fe)) b(kind, t)),
z AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY file_id, kind ORDER BY abs((start_sec + end_sec) / 2 - t), start_sec, segment_id) = 1)
SELECT file_id, kind AS boundary_type, segment_id AS nearest_segment_id, start_sec AS nearest_start_sec, end_sec AS nearest_end_sec, round(prob, 6) AS nearest_probability, round(prob - lower, 6) AS delta_before, round(prob - higher, 6) AS delta_after,
  round(coalesce(greatest(prob - lower, prob - higher), prob), 4) AS boundary_signal_strength FROM z""")
def boundary_segments(spark, sf):
    return rounded(V.boundary_rows(with_region(spark, sf), "file_id", "segment_id", "prob"))


# Chunk timelines -----------------------------------------------------------------------

TL = f"""WITH t AS ({I.TIMELINE_SQL}), ev AS (SELECT * FROM t WHERE spoof_probability IS NOT NULL QUALIFY evaluated OR NOT bool_or(evaluated) OVER (PARTITION BY sample_id)),
pr AS (SELECT *, from_json(attack_probs, '["DOUBLE"]') AS v FROM ev)"""


def dom_sql(src, keys):
    return f"""(SELECT {keys}, coalesce(CASE WHEN s[1] IS NULL THEN NULL WHEN s[1] >= greatest(s[2], s[3], s[4]) THEN 'bonafide' WHEN s[2] >= greatest(s[3], s[4]) THEN 'synthesis' WHEN s[3] >= s[4] THEN 'conversion' ELSE 'replay' END, ty) AS dom
   FROM (SELECT {keys}, [sum(v[1]), sum(v[2]), sum(v[3]), sum(v[4])] AS s FROM {src} GROUP BY ALL) JOIN (SELECT {keys}, attack_type AS ty FROM {src} GROUP BY {keys}, attack_type QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, attack_type) = 1) USING ({keys}))"""


@query("a42_chunk_metrics", f"""{TL}, b AS (SELECT sample_id, count(*) FILTER (spoof_probability >= 0.65) AS suspicious_chunk_count, round(count(*) FILTER (spoof_probability >= 0.65) / count(*), 6) AS suspicious_chunk_ratio,
  round(max(spoof_probability), 6) AS max_chunk_spoof, round(avg(spoof_probability), 6) AS mean_chunk_spoof, round(quantile_cont(spoof_probability, 0.5), 6) AS median_chunk_spoof FROM ev GROUP BY ALL)
SELECT b.*, d.dom AS dominant_chunk_attack FROM b JOIN {dom_sql('pr', 'sample_id')} d USING (sample_id)""")
def chunk_metrics(spark, sf):
    return rounded(T.chunk_metrics(I.timeline(spark, sf)))


@query("a43_dominant_attack", f"""{TL}, q AS (SELECT sample_id, CAST(chunk_id % 3 AS INTEGER) AS part, attack_type, v FROM pr) SELECT sample_id, part, dom AS dominant_attack FROM {dom_sql('q', 'sample_id, part')}""")
def dominant_attack(spark, sf):
    ev = T.evaluated_chunks(I.timeline(spark, sf)).withColumn("part", (c("chunk_id") % 3).cast("int"))
    return T.dominant_attack(ev, ["sample_id", "part"])


@query("a44_region_metrics", f"""{TL}, z AS (SELECT *, CASE WHEN start_time < region_end AND end_time > region_start THEN 'inside' ELSE 'outside' END AS side FROM pr WHERE region_end > region_start),
b AS (SELECT sample_id, count(*) FILTER (side = 'inside') AS n_chunks_inside, count(*) FILTER (side = 'outside') AS n_chunks_outside, avg(spoof_probability) FILTER (side = 'inside') AS ia, avg(spoof_probability) FILTER (side = 'outside') AS oa,
  max(spoof_probability) FILTER (side = 'inside') AS im, max(spoof_probability) FILTER (side = 'outside') AS om FROM z GROUP BY ALL),
d AS (SELECT sample_id, max(dom) FILTER (side = 'inside') AS di, max(dom) FILTER (side = 'outside') AS dout FROM {dom_sql('z', 'sample_id, side')} GROUP BY ALL)
SELECT sample_id, n_chunks_inside, n_chunks_outside, round(ia, 6) AS inside_region_avg_spoof, round(oa, 6) AS outside_region_avg_spoof, round(im, 6) AS inside_region_max_spoof, round(om, 6) AS outside_region_max_spoof,
  di AS inside_region_dominant_attack, dout AS outside_region_dominant_attack, n_chunks_inside > 0 AND (coalesce(ia >= oa + 0.15::DOUBLE, false) OR coalesce(im >= 0.65, false) OR (coalesce(di IN ('synthesis', 'conversion'), false) AND coalesce(dout, 'bonafide') = 'bonafide')) AS partial_region_detected
FROM b JOIN d USING (sample_id)""")
def region_metrics(spark, sf):
    return rounded(T.region_metrics(I.timeline(spark, sf)))


@query("a44_window_region_metrics", f"""WITH t AS ({I.TIMELINE_SQL}), b AS (SELECT sample_id, count(*) FILTER (end_time > region_start AND start_time < region_end) AS n_inside, count(*) FILTER (NOT (end_time > region_start AND start_time < region_end)) AS n_outside,
  avg(spoof_probability) FILTER (end_time > region_start AND start_time < region_end) AS ia, max(spoof_probability) FILTER (end_time > region_start AND start_time < region_end) AS im,
  coalesce(avg(spoof_probability) FILTER (NOT (end_time > region_start AND start_time < region_end)), 0) AS oa FROM t GROUP BY ALL)
SELECT sample_id, n_inside, n_outside, round(ia, 6) AS inside_avg, round(im, 6) AS inside_max, round(oa, 6) AS outside_avg, round(ia - oa, 6) AS region_delta, coalesce(im >= 0.99 OR ia - oa >= 0.1::DOUBLE, false) AS partial_region_detected FROM b""")
def window_region_metrics(spark, sf):
    return rounded(T.window_region_metrics(I.timeline(spark, sf), 0.99))


ISL = f"""{TL}, h AS (SELECT *, max(end_time) OVER (PARTITION BY sample_id ORDER BY start_time, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev WHERE spoof_probability >= 0.65),
i AS (SELECT *, sum(CASE WHEN start_time <= reach + 0.01::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY start_time, chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM h),
reg AS (SELECT sample_id, island, min(start_time) AS start_time, max(end_time) AS end_time, max(spoof_probability) AS max_spoof, avg(spoof_probability) AS mean_spoof, count(*) AS chunk_count FROM i GROUP BY ALL)"""


@query("w16_suspicious_regions", f"""{ISL}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY max_spoof DESC, end_time - start_time DESC, start_time) AS rk FROM reg)
SELECT sample_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(max_spoof, 6) AS max_spoof, round(mean_spoof, 6) AS mean_spoof, chunk_count, CAST(rk AS INTEGER) AS region_rank FROM k WHERE rk <= 3""")
def suspicious_regions(spark, sf):
    return rounded(T.suspicious_regions(I.timeline(spark, sf)))


@query("w17_suspicious_segments", f"""WITH t AS ({I.TIMELINE_SQL}), top AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY spoof_probability DESC, chunk_id) AS pos FROM t),
r AS (SELECT sample_id, region_start, region_end, max(spoof_probability) FILTER (start_time < region_end AND end_time > region_start) AS ev FROM t GROUP BY ALL),
u AS (SELECT sample_id, 0 AS pos, region_start AS start_time, region_end AS end_time, 'labeled_partial_region' AS segment_type, coalesce(ev, 0) AS evidence_score, 'high' AS review_priority FROM r
  UNION ALL SELECT sample_id, pos, start_time, end_time, 'high_spoof_chunk', spoof_probability, CASE WHEN spoof_probability >= 0.85 THEN 'high' ELSE 'medium' END FROM top WHERE pos <= 10 AND spoof_probability >= 0.65),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY sample_id, round(start_time, 2), round(end_time, 2) ORDER BY pos) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rk FROM d)
SELECT sample_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, segment_type, round(evidence_score, 6) AS evidence_score, review_priority, CAST(rk AS INTEGER) AS segment_rank FROM k WHERE rk <= 5""")
def suspicious_segments(spark, sf):
    t = I.timeline(spark, sf)
    inside = V.overlaps(c("start_time"), c("end_time"), c("region_start"), c("region_end"))
    regions = t.groupBy("sample_id", "region_start", "region_end").agg(
        F.max(F.when(inside, c("spoof_probability"))).alias("evidence"))
    return rounded(T.suspicious_segments(t, regions))


@query("w18_merged_candidates", f"""{SEG}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id) AS rk, row_number() OVER (PARTITION BY file_id ORDER BY start_sec, segment_id) AS ch FROM g),
u AS (SELECT file_id, rk AS rank, start_sec, end_sec, prob, 0 AS src FROM k WHERE rk = 1 UNION ALL SELECT file_id, rk, start_sec, end_sec, prob, 1 FROM k WHERE rk <= 3 UNION ALL SELECT file_id, ch, start_sec, end_sec, prob, 2 FROM k WHERE ch <= 5)
SELECT file_id, CAST(rank AS INTEGER) AS rank, start_sec, end_sec, round(prob, 6) AS probability FROM u QUALIFY row_number() OVER (PARTITION BY file_id, start_sec, end_sec ORDER BY src, rank) = 1""")
def merged_candidates(spark, sf):
    seg = I.segments(spark, sf).select("file_id", "segment_id", "start_sec", "end_sec", c("prob").alias("probability"))
    by_score = [c("probability").desc(), c("start_sec").asc(), c("segment_id").asc()]
    top = top_rows(seg, ["file_id"], by_score, 3, "rank")
    early = top_rows(seg, ["file_id"], by_score[1:], 5, "rank")
    return rounded(T.merged_candidates("file_id", top.where("rank = 1"), top, early))
