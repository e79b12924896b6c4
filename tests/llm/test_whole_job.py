"""Cases in which an operator or a stage used to do less than the whole job."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import SMALL  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from echotrail.llm import decontaminate, lm_score, near_copies, quality_ftrl, vector_dedup
from echotrail.llm.common import labelled_sample, table


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def jaccard_groups(rows, least=0.8):
    """Smallest id of every row's component, by all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= least * max(len(sets[a] | sets[b]), 1):
                root[find(a)] = find(b)
    out = {}
    for k, (i, _) in enumerate(rows):
        out[find(k)] = min(out.get(find(k), i), i)
    return set(out.values())


def test_near_dedup_reaches_a_similarity_of_eight_tenths(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5_000)}"
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        texts.append(base)
        for rate in (0.003, 0.01, 0.02, 0.03, 0.06):
            texts.append([word() if rng.random() < rate else w for w in base])
    rows = list(enumerate([" ".join(t) for t in texts] + ["", None, "two words", "Two  words", "two other"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_groups(rows)
    assert len(want) < len(rows) - 60
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs.repartition(5), SMALL).collect()} == want


def test_near_dedup_starts_from_fingerprints(spark, monkeypatch):
    """With the search for the rest switched off, the Golay keys still find near copies, and the exact check parts other texts."""
    monkeypatch.setattr(near_copies, "possible", lambda *a: F.lit(False))
    alpha, beta = "alpha " * 200, "beta " * 200  # one shingle that sets the fingerprint
    own = [" ".join(f"{c}{k}" for k in range(40)) for c in "xyz"]
    rows = [(1, alpha + own[0]), (2, alpha + own[0] + " end"), (3, beta + own[0]), (6, beta + own[1]), (4, own[2]), (5, own[2].upper()), (None, None)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SMALL).collect()
    assert {r["doc_id"] for r in kept} == {1, 3, 4, 6, None} and len(kept) == 5


@pytest.mark.parametrize("many", [300, 600])
def test_templates_are_no_candidates(spark, monkeypatch, many):
    """Texts that share most of their words but are not similar cost a few comparisons each, not one for every other text."""
    rng = random.Random(6)
    common = " ".join(f"c{k}" for k in range(200))
    rows = [(k, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for k in range(many)]
    rows += [(many + k, rows[k][1] + " end") for k in range(20)]
    compared, similar = [], near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    kept = near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(many))
    assert sum(compared) < 10 * many


def test_near_dedup_of_null_ids_and_repeated_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(None, a), (3, a + " more"), (None, b), (None, b), (7, None), (5, " ")]
    kept = near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(3, a + " more"), (None, b), (5, " ")} and len(kept) == 3


def test_vector_groups_are_bounded_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    vectors = np.concatenate([base, base[:100] + 0.1 * rng.normal(size=(100, 64))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    reps = df.withColumn("rep", F.xxhash64("label", "embedding"))
    monkeypatch.setattr(vector_dedup, "TILE", 10)
    rows = vector_dedup.block_rows(reps, 0.93)
    grouped, asked = type(rows).groupBy, []

    def watched(self, *keys):
        if "tile" in keys:
            asked.extend(grouped(self, *keys).agg(F.sum(F.col("home").cast("int")), F.sum((~F.col("home")).cast("int"))).select(
                F.col("sum(CAST(home AS INT))").alias("homes"), F.col("sum(CAST((NOT home) AS INT))").alias("looks")).collect() if not asked else [])
        return grouped(self, *keys)

    monkeypatch.setattr(type(rows), "groupBy", watched)
    got = {(r["a"], r["b"]) for r in vector_dedup.candidates(rows, 0.93, tile=10).collect()}
    assert max(r["homes"] for r in asked) <= 30 and max(r["looks"] for r in asked) <= 80
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    ids = {r["vec_id"]: r["rep"] for r in reps.collect()}
    linked = [(i, j) for i in range(len(unit)) for j in range(i) if unit[i] @ unit[j] >= 0.93]
    assert len(linked) >= 90
    assert all((min(ids[i], ids[j]), max(ids[i], ids[j])) in got for i, j in linked)


def test_quality_scores_do_not_depend_on_the_sample(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents").limit(6_000), table(spark, folder, "labels")
    seen = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    means = {}
    for rows in (700, 6_000):
        model = quality_ftrl.fit_documents(docs, seen, quality_ftrl.Settings(sample_rows=rows))
        scores = quality_ftrl.score(docs, model, ["doc_id"]).agg(F.avg("score"), F.avg("predicted")).first()
        means[rows] = scores
    print(means)
    assert abs(means[700][0] - means[6_000][0]) < 0.03


@pytest.mark.parametrize("lines", [1, 2, 3, 4, 5, 6])
def test_passages_between_different_neighbours_go_whole(spark, lines):
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    body = [words(f"l{k}of{lines}x", 60 if lines == 1 else 6) for k in range(lines)]
    rows = [(k, "\n".join([f"head {k}", f"own {k}", *body, f"tail {k}", "", f"end {k}"])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 12):
        assert got[k] == f"head {k}\nown {k}\ntail {k}\n\nend {k}"


def test_last_stage_returns_the_tokens(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    for r in corpus_pipeline.token_ids(spark, docs, SMALL).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]


def test_last_stage_needs_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "a <|endoftext|> b\u00a0 \U0001f600")], "doc_id long, text string")
    out = corpus_pipeline.token_ids(spark, docs, SMALL)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r["doc_id"], r["round_trip"]) for r in out.orderBy("doc_id").collect()] == [(1, True), (2, True), (3, True)]


def test_sample_holds_one_document_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k % 7}") for k in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", 100, 99, 10).collect()
    assert sorted((r["doc_key"], r["label"]) for r in sample) == [(1, 1), (2, 0)]


def test_backoff_parts_are_settled(spark, monkeypatch):
    """Row ids that change between two readings, as after a lost executor, must not reach the result."""
    shaky = F.udf(lambda: random.randrange(10**9), "long").asNondeterministic()
    monkeypatch.setattr(F, "monotonically_increasing_id", lambda: shaky())
    monkeypatch.setattr(lm_score, "PART", 200)
    docs = spark.createDataFrame([(k, f"a b c{k % 5} d e{k % 3} f") for k in range(60)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: round(r["lm_score"], 6) for r in lm_score.score(docs, ["doc_id"]).collect()}
    monkeypatch.setattr(lm_score, "PART", 12_000_000)
    want = {r["doc_id"]: round(r["lm_score"], 6) for r in lm_score.score(docs, ["doc_id"]).collect()}
    assert len(got) == 60 and got == want


def test_backoff_of_a_scan_that_is_split_anew(spark, monkeypatch, tmp_path):
    """A scan cut differently between asking and looking up finds the same totals; parts of several splits included."""
    texts = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 9)) or None) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    want = {r["doc_id"]: round(r["lm_score"], 6) for r in lm_score.score(docs, ["doc_id"]).collect()}
    monkeypatch.setattr(lm_score, "PART", 600)
    monkeypatch.setattr(lm_score, "RANGE", 500)
    scored = lm_score.score(spark.read.parquet(f"{tmp_path}/docs"), ["doc_id"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["doc_id"]: round(r["lm_score"], 6) for r in scored.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 300 and got == want


def test_shortened_hashes_tell_asked_ngrams_apart():
    rng = np.random.default_rng(3)
    near = np.uint64(1 << 40) + np.arange(50, dtype=np.uint64)  # neighbours that differ in the last bits alone
    asked = {7: np.unique(np.append(rng.integers(0, 1 << 63, 400, np.uint64), near)), 9: rng.integers(0, 1 << 63, 3, np.uint64)}
    asked[9] = np.unique(np.append(asked[9], asked[7][::5]))
    rows = [(part, lm_score.packed(np.diff(g, prepend=np.uint64(0))), lm_score.packed(np.ones(len(g), np.uint32))) for part, g in asked.items()]
    table = pa.table({"part": pa.array([r[0] for r in rows]), "gram": pa.array([2, 2], pa.int32()), "slot": pa.array([0, 0], pa.int32()),
                      "hashes": [r[1] for r in rows], "counts": [r[2] for r in rows]})
    answers = lm_score.answer(2)((pa.scalar(2), pa.scalar(0)), table).to_pylist()
    for part, grams in asked.items():
        found = lm_score.looked_up(grams, [r for r in answers if r["part"] == part], 2, lm_score.slot_edges(1), 0)
        assert found.tolist() == [2 if g in asked[7] and g in asked[9] else 0 for g in grams]


def test_decontamination_adds_up_runs(spark):
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "su", "ta") for b in ("rn", "st", "ld", "ck", "mp", "sh", "nd")]
    item, short = words[:38], words[20:42]
    numbers = "3 + 4 = 7 and 12 + 9 = 21 and 5 + 6 = 11 and 8 + 2 = 10".split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(numbers))], "item_id long, text string")
    texts = {1: item[:19] + ["inserted"] + item[19:], 2: item[:19] + item[20:], 3: ["so"] + item[4:26] + ["it", "ends"],
             4: short[:11] + ["changed"] + short[12:], 5: ["see"] + numbers + ["done"], 6: item[:12], 7: ["2 + 2 = 4 and 1 + 1 = 2"]}
    docs = spark.createDataFrame([(k, "zz " + " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    for rows in (500_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, broadcast_rows=rows).collect()}
        assert {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)} <= got and not {d for d, _ in got} & {6, 7}


def test_quality_scores_follow_the_labels_class_mix(spark):
    docs = spark.createDataFrame([(k, "some equal words") for k in range(1_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 > 0)) for k in range(1_000)], "doc_id long, quality int")
    model = quality_ftrl.fit_documents(docs, labels, quality_ftrl.Settings(sample_rows=100))
    assert 0.72 < quality_ftrl.score(docs.limit(1), model, ["doc_id"]).first()["score"] < 0.95
