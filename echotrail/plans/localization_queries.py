"""Within-recording ranking, deviation, transitions and candidate segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions.numbers import row_mean
from echotrail.operators import localize as Z
from echotrail.operators.skew import (
    join_ids, min_rank_descending, neighbours, numbered, percent_rank_average, top_rows,
)
from echotrail.plans import inputs as I
from echotrail.plans.metric_queries import rounded
from echotrail.plans.profile_queries import group_effects
from echotrail.plans.registry import query
from echotrail.plans.window_queries import OV, REGION_LABEL, SEG
from echotrail.operators.intervals import overlap_label

c = F.col
GROUPS = {"acoustic": ["a1", "a2"], "ssl": ["e1", "e2"]}
COLS = ["a1", "a2", "e1", "e2"]
# whole-number features, so distances come out the same in any engine
LOC = f"""WITH g AS ({I.SEGMENTS_SQL}), x AS (SELECT file_id, segment_id, start_sec, end_sec, prob, y_true, f_quantity AS a1, round(f_price * 100) AS a2, round(f_discount * 100) AS e1,
  CASE WHEN f_tax > 0 THEN round(f_tax * 100) END AS e2 FROM g)"""


def loc_inputs(spark, sf):
    return I.segments(spark, sf).select(
        "file_id", "segment_id", "start_sec", "end_sec", "prob", "y_true", c("f_quantity").alias("a1"),
        F.round(c("f_price") * 100).alias("a2"), F.round(c("f_discount") * 100).alias("e1"),
        F.when(c("f_tax") > 0, F.round(c("f_tax") * 100)).alias("e2"))


MED = "quantile_cont({x}, 0.5) OVER (PARTITION BY file_id)"
STATS = f"""{LOC}, m AS (SELECT *, {', '.join(f"{MED.format(x=k)} AS med_{k}" for k in COLS)} FROM x),
d AS (SELECT *, {', '.join(f"nullif(quantile_cont(abs({k} - med_{k}), 0.5) OVER (PARTITION BY file_id), 0) AS mad_{k}" for k in COLS)} FROM m),
z AS (SELECT *, {', '.join(f"({k} - med_{k}) / (1.4826::DOUBLE * mad_{k}) AS z_{k}" for k in COLS)},
  sqrt(coalesce(a1 - med_a1, 0) * coalesce(a1 - med_a1, 0) + coalesce(a2 - med_a2, 0) * coalesce(a2 - med_a2, 0)) AS acoustic_distance,
  sqrt(coalesce(e1 - med_e1, 0) * coalesce(e1 - med_e1, 0) + coalesce(e2 - med_e2, 0) * coalesce(e2 - med_e2, 0)) AS ssl_distance FROM d)"""
PCT = "CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY file_id ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY file_id, {v}) - 1) / 2) / count({v}) OVER (PARTITION BY file_id) END"


def mean_sql(*xs):
    n = " + ".join(f"({x} IS NOT NULL)::INT" for x in xs)
    return f"(CASE WHEN {n} > 0 THEN ({' + '.join(f'coalesce({x}, 0::DOUBLE)' for x in xs)}) / ({n}) END)"


@query("w1_percent_rank", f"{LOC} SELECT file_id, segment_id, round({PCT.format(v='e2')}, 9) AS pct FROM x")
def percent_rank(spark, sf):
    out = percent_rank_average(loc_inputs(spark, sf), ["file_id"], "e2", "pct")
    return rounded(out.select("file_id", "segment_id", "pct"), 9)


@query("w2_min_rank", f"{LOC} SELECT file_id, segment_id, CASE WHEN e2 IS NOT NULL THEN rank() OVER (PARTITION BY file_id ORDER BY e2 DESC NULLS LAST) END AS rank FROM x")
def min_rank(spark, sf):
    return min_rank_descending(loc_inputs(spark, sf), ["file_id"], "e2", "rank").select("file_id", "segment_id", "rank")


@query("w3_first_rank", f"""{LOC} SELECT file_id, segment_id, row_number() OVER (PARTITION BY file_id ORDER BY start_sec, segment_id) - 1 AS chronological_index,
  row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id) AS score_rank FROM x""")
def first_rank(spark, sf):
    time = [c("start_sec").asc(), c("segment_id").asc()]
    t = numbered(loc_inputs(spark, sf), ["file_id"], time, "_chron")
    t = numbered(t, ["file_id"], [c("prob").desc(), *time], "score_rank")
    return t.select("file_id", "segment_id", (c("_chron") - 1).alias("chronological_index"), "score_rank")


@query("w4_neighbour_ids", f"""{LOC} SELECT file_id, segment_id, lag(segment_id, 2) OVER w AS prev_segment_id, lead(segment_id, 2) OVER w AS next_segment_id FROM x WINDOW w AS (PARTITION BY file_id ORDER BY start_sec, segment_id)""")
def neighbour_ids(spark, sf):
    t = neighbours(loc_inputs(spark, sf), ["file_id"], [c("start_sec").asc(), c("segment_id").asc()],
                   "segment_id", 2, "prev_segment_id", "next_segment_id")
    return t.select("file_id", "segment_id", "prev_segment_id", "next_segment_id")


def delta_sql(off, *ks):
    return mean_sql(*[f"abs(z_{k} - {off}(z_{k}, 1) OVER w)" for k in ks])


DELTA = STATS + f""", nd AS (SELECT *, {delta_sql('lag', 'a1', 'a2')} AS acoustic_prev_delta, {delta_sql('lead', 'a1', 'a2')} AS acoustic_next_delta, {delta_sql('lag', 'e1', 'e2')} AS ssl_prev_delta, {delta_sql('lead', 'e1', 'e2')} AS ssl_next_delta
  FROM z WINDOW w AS (PARTITION BY file_id ORDER BY start_sec, segment_id)), n AS (SELECT *, greatest(acoustic_prev_delta, acoustic_next_delta) AS max_acoustic_delta, greatest(ssl_prev_delta, ssl_next_delta) AS max_ssl_delta FROM nd)"""


@query("w5_neighbour_deltas", DELTA + " SELECT file_id, segment_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in (
    "acoustic_prev_delta", "acoustic_next_delta", "ssl_prev_delta", "ssl_next_delta", "max_acoustic_delta", "max_ssl_delta")) + " FROM n")
def neighbour_deltas(spark, sf):
    t = Z.with_medians(loc_inputs(spark, sf), ["file_id"], COLS)
    t = Z.neighbour_deltas(t, "file_id", [c("start_sec").asc(), c("segment_id").asc()], GROUPS)
    return rounded(t.select("file_id", "segment_id", *[f"{g}_{s}" for g in GROUPS for s in ("prev_delta", "next_delta")],
                            "max_acoustic_delta", "max_ssl_delta"))


@query("w6_robust_z", STATS + " SELECT file_id, segment_id, " + ", ".join(f"round(z_{k}, 6) AS z_{k}" for k in COLS) + " FROM z")
def robust_z(spark, sf):
    t = Z.with_medians(loc_inputs(spark, sf), ["file_id"], COLS)
    return rounded(t.select("file_id", "segment_id", *[Z.robust_z(k).alias(f"z_{k}") for k in COLS]))


@query("w7_median_distance", STATS + " SELECT file_id, segment_id, round(acoustic_distance, 3) AS acoustic_distance, round(ssl_distance, 3) AS ssl_distance FROM z")
def median_distance(spark, sf):
    t = Z.with_medians(loc_inputs(spark, sf), ["file_id"], COLS)
    return rounded(t.select("file_id", "segment_id", *[Z.distance_from_median(k).alias(f"{g}_distance") for g, k in GROUPS.items()]), 3)


def base_sql(side, k):
    return f"quantile_cont(CASE WHEN y_true = {1 if side == 'in' else 0} THEN {k} END, 0.5) OVER (PARTITION BY file_id) AS {side}_{k}"


def dist_sql(side, *ks):
    return "CASE WHEN has_both THEN " + mean_sql(*[f"abs(({k} - {side}_{k}) / (1.4826::DOUBLE * mad_{k}))" for k in ks]) + " END"


MARGIN = DELTA + f""", bs AS (SELECT *, {', '.join(base_sql(s, k) for s in ('in', 'out') for k in COLS)}, max(y_true) OVER (PARTITION BY file_id) = 1 AND min(y_true) OVER (PARTITION BY file_id) = 0 AS has_both FROM n),
mg0 AS (SELECT *, {dist_sql('out', 'a1', 'a2')} AS acoustic_dist_out, {dist_sql('in', 'a1', 'a2')} AS acoustic_dist_in, {dist_sql('out', 'e1', 'e2')} AS ssl_dist_out, {dist_sql('in', 'e1', 'e2')} AS ssl_dist_in FROM bs),
mg AS (SELECT *, acoustic_dist_out - acoustic_dist_in AS acoustic_margin, ssl_dist_out - ssl_dist_in AS ssl_margin, {mean_sql('acoustic_dist_out', 'ssl_dist_out')} - {mean_sql('acoustic_dist_in', 'ssl_dist_in')} AS combined_margin FROM mg0)"""
MARGINS = ["acoustic_dist_out", "acoustic_dist_in", "ssl_dist_out", "ssl_dist_in", "acoustic_margin", "ssl_margin", "combined_margin"]


@query("w8_baseline_margins", MARGIN + " SELECT file_id, segment_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in MARGINS) + " FROM mg")
def baseline_margins(spark, sf):
    t = Z.with_medians(loc_inputs(spark, sf), ["file_id"], COLS)
    t = Z.baseline_margins(t, "file_id", GROUPS, c("y_true") == 1, c("y_true") == 0)
    return rounded(t.select("file_id", "segment_id", *MARGINS))


CAND = MARGIN + f""", p AS (SELECT *, {PCT.format(v='acoustic_distance')} AS ad, {PCT.format(v='ssl_distance')} AS sd, {PCT.format(v='max_acoustic_delta')} AS atr, {PCT.format(v='max_ssl_delta')} AS st, {PCT.format(v='combined_margin')} AS mr,
   count(*) OVER (PARTITION BY file_id) AS segment_count FROM mg),
q AS (SELECT *, {mean_sql('ad', 'sd')} AS combined_deviation, {mean_sql('atr', 'st')} AS combined_transition FROM p),
s AS (SELECT *, round({mean_sql('combined_deviation', 'combined_transition', 'mr')}, 9) AS candidate_score FROM q),
r AS (SELECT *, rank() OVER (PARTITION BY file_id ORDER BY candidate_score DESC NULLS LAST) AS candidate_rank FROM s),
k AS (SELECT *, CASE WHEN segment_count < 2 THEN 'insufficient_data' WHEN candidate_rank <= 2 AND combined_deviation >= 0.65 AND combined_transition >= 0.65 AND combined_margin >= 0.65 THEN 'combined_localization_candidate'
  WHEN candidate_rank <= 2 AND combined_deviation >= 0.7 AND combined_transition >= 0.7 THEN 'both_deviation_and_transition' WHEN candidate_rank <= 2 AND combined_deviation < combined_transition THEN 'neighbor_transition_candidate'
  WHEN candidate_rank <= 2 AND combined_deviation > combined_transition THEN 'within_file_deviation_candidate' WHEN candidate_rank <= 2 AND combined_margin >= combined_deviation AND combined_margin >= combined_transition THEN 'inside_outside_candidate' ELSE 'not_top_candidate' END AS candidate_type FROM r)"""


def candidates(spark, sf):
    return Z.localization_candidates(loc_inputs(spark, sf), "file_id", "segment_id", GROUPS,
                                     c("y_true") == 1, c("y_true") == 0, top_k=2)


@query("w9_combined_scores", CAND + " SELECT file_id, segment_id, round(combined_deviation, 6) AS combined_deviation, round(combined_transition, 6) AS combined_transition FROM k")
def combined_scores(spark, sf):
    return rounded(candidates(spark, sf).select("file_id", "segment_id", "combined_deviation", "combined_transition"))


LIVE = f"""{LOC}, m AS (SELECT *, {', '.join(f"{MED.format(x=k)} AS med_{k}" for k in COLS)} FROM x),
d AS (SELECT *, {mean_sql('abs(a1 - med_a1)', 'abs(a2 - med_a2)')} AS ad, {mean_sql('abs(e1 - med_e1)', 'abs(e2 - med_e2)')} AS sd,
  {mean_sql('abs(a1 - lag(a1) OVER w)', 'abs(a2 - lag(a2) OVER w)')} AS atr, {mean_sql('abs(e1 - lag(e1) OVER w)', 'abs(e2 - lag(e2) OVER w)')} AS st FROM m WINDOW w AS (PARTITION BY file_id ORDER BY start_sec, segment_id)),
l AS (SELECT *, {PCT.format(v='ad')} AS ap, {PCT.format(v='sd')} AS sp, ad / (max(ad) OVER (PARTITION BY file_id) + 1e-9::DOUBLE) AS asc_, sd / (max(sd) OVER (PARTITION BY file_id) + 1e-9::DOUBLE) AS ssc FROM d)"""


@query("w10_live_features", f"""{LIVE} SELECT file_id, segment_id, round(ad, 6) AS acoustic_distance, round(sd, 6) AS ssl_distance, round(ap, 6) AS acoustic_deviation_percentile, round(sp, 6) AS ssl_deviation_percentile,
  round(asc_, 6) AS acoustic_deviation_score, round(ssc, 6) AS ssl_deviation_score, round(atr, 6) AS acoustic_transition_score, round(st, 6) AS ssl_transition_score,
  round({mean_sql('asc_', 'ssc')}, 6) AS combined_deviation_score, round({mean_sql('atr', 'st')}, 6) AS combined_transition_score FROM l""")
def live_features(spark, sf):
    return rounded(Z.live_features(loc_inputs(spark, sf), "file_id", "segment_id", GROUPS).drop("start_sec", "end_sec", "prob", "y_true", *COLS))


@query("w11_candidate_classes", CAND + " SELECT file_id, segment_id, candidate_rank, candidate_type, round(candidate_score, 6) AS candidate_score FROM k")
def candidate_classes(spark, sf):
    return rounded(candidates(spark, sf).select("file_id", "segment_id", "candidate_rank", "candidate_type", "candidate_score"))


@query("w12_top_features", """WITH l AS (SELECT unnest(['quantity', 'price', 'discount', 'tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x, l_returnflag, l_linestatus FROM lineitem),
s AS (SELECT l_returnflag AS comparison_name, feature, l_linestatus AS side, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY ALL),
e AS (SELECT comparison_name, feature, round(abs(max(m) FILTER (side = 'F') - max(m) FILTER (side = 'O')) / sqrt((max(v) FILTER (side = 'F') + max(v) FILTER (side = 'O')) / 2), 6) AS effect_size FROM s GROUP BY ALL)
SELECT comparison_name, feature, effect_size, CAST(row_number() OVER w AS INTEGER) AS rank FROM e WINDOW w AS (PARTITION BY comparison_name ORDER BY coalesce(effect_size, -1) DESC, feature) QUALIFY row_number() OVER w <= 2""")
def top_features(spark, sf):
    from echotrail.operators.profile import feature_long, group_effects as effects
    li = I.table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("comparison_name"), F.when(c("l_linestatus") == "F", "a").otherwise("b").alias("_side"),
        c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"), c("l_tax").alias("tax"))
    long = feature_long(li, ["quantity", "price", "discount", "tax"], ["comparison_name", "_side"])
    e = rounded(effects(long, ["comparison_name"]).select("comparison_name", "feature", "effect_size"))
    return top_rows(e, ["comparison_name"], [F.coalesce("effect_size", F.lit(-1.0)).desc(), c("feature").asc()], 2, "rank")


@query("w13_top_candidates", CAND + " SELECT file_id, segment_id, candidate_rank, candidate_type FROM k WHERE candidate_type <> 'not_top_candidate' OR candidate_rank <= 2 OR round(combined_margin, 6) >= 0.75 OR round(combined_transition, 6) >= 0.80")
def top_candidates(spark, sf):
    t = candidates(spark, sf)
    keep = ((c("candidate_type") != "not_top_candidate") | (c("candidate_rank") <= 2)
            | (F.round("combined_margin", 6) >= 0.75) | (F.round("combined_transition", 6) >= 0.80))
    return t.where(keep).select("file_id", "segment_id", "candidate_rank", "candidate_type")


@query("w14_top_segments", f"""{SEG}, r AS (SELECT g.*, region_start AS fs, region_end AS fe FROM g JOIN f USING (file_id) WHERE file_category = 'human_fabricated'),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id) AS rk FROM r)
SELECT file_id, segment_id, CAST(rk AS INTEGER) AS segment_rank, round(prob, 6) AS segment_probability, CASE WHEN fe IS NULL THEN 'timestamp_unavailable' WHEN {OV} / 4 >= 0.5 THEN 'overlaps_fabricated_timestamp' ELSE 'outside_fabricated_timestamp' END AS relation FROM k WHERE rk <= 10""")
def top_segments(spark, sf):
    cases = I.files(spark, sf).where(c("file_category") == "human_fabricated").select("file_id", "region_start", "region_end")
    t = top_rows(join_ids(I.segments(spark, sf), cases, ["file_id"]), ["file_id"],
                 [c("prob").desc(), c("start_sec").asc(), c("segment_id").asc()], 10, "segment_rank")
    lab = overlap_label(c("start_sec"), c("end_sec"), c("region_start"), c("region_end"), 0.5)["region_label"]
    # a boundary segment counts as outside here
    return t.select("file_id", "segment_id", "segment_rank", F.round("prob", 6).alias("segment_probability"),
                    F.when(c("region_end").isNull(), "timestamp_unavailable").when(
                        lab == "inside_fabricated_region", "overlaps_fabricated_timestamp").otherwise("outside_fabricated_timestamp").alias("relation"))


RANGES = """SELECT file_id, string_agg(CAST(start_sec AS VARCHAR) || '-' || CAST(end_sec AS VARCHAR), ';' ORDER BY rk) AS top_segment_ranges FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id) AS rk FROM g) WHERE rk <= 3 GROUP BY file_id"""


@query("w15_top_ranges", f"WITH g AS ({I.SEGMENTS_SQL}) {RANGES}")
def top_ranges(spark, sf):
    return Z.top_ranges(I.segments(spark, sf), "file_id", "segment_id", "prob")


@query("w19_review_sample", f"""WITH m AS ({I.MANIFEST_SQL}), l AS (SELECT 'label' AS field, label AS value, doc_id, filepath, split FROM m WHERE trim(coalesce(label, '')) <> '' UNION ALL SELECT 'attack_type', attack_type, doc_id, filepath, split FROM m WHERE trim(coalesce(attack_type, '')) <> ''
  UNION ALL SELECT 'dataset', dataset, doc_id, filepath, split FROM m UNION ALL SELECT 'domain', domain, doc_id, filepath, split FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY field, value ORDER BY doc_id) AS rk FROM l) SELECT field, value, doc_id, filepath, split, CAST(rk AS INTEGER) AS rank_in_group FROM k WHERE rk <= 7""")
def review_sample(spark, sf):
    from echotrail.operators.profile import unpivot
    m = I.manifest(spark, sf)
    long = unpivot(m, ["label", "attack_type", "dataset", "domain"], ["doc_id", "filepath", "split"], "field").where(F.trim(F.coalesce("value", F.lit(""))) != "")
    return top_rows(long, ["field", "value"], [c("doc_id").asc()], 7)


@query("w20_first_row", f"""WITH f AS ({I.FILES_SQL}) SELECT speaker_id, file_id, gate_prob, duration_sec FROM f QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY gate_prob DESC, duration_sec, file_id DESC) = 1""")
def first_row(spark, sf):
    best = I.files(spark, sf).groupBy("speaker_id").agg(F.max(F.struct(
        "gate_prob", (-c("duration_sec")).alias("nd"), "file_id", "duration_sec")).alias("b"))
    return best.select("speaker_id", "b.file_id", "b.gate_prob", "b.duration_sec")
