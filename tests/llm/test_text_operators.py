"""Text operators against plain Python on edge tables and the smallest given tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from edge_rows import SMALL, small_labels, texts  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echotrail.llm import bpe, decontaminate, line_chunks, lm_score, queries, quality_ftrl, simhash_golay, token_files, toxicity
from echotrail.llm.common import components, crc32_mod, labelled_sample, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_components_match_union_find(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 9), (9, 7), (7, 8), (8, 6), (20, 10), (10, 20), (4, 4)] + [(100, 100 + k) for k in range(1, 30)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 10, 20: 10} | {100 + k: 100 for k in range(30)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_equals_the_library(spark, texts, tokenizer):
    for docs in (texts, texts.limit(0), table(spark, SMALL, "documents")):
        coded = bpe.encode(docs, PATH, ["doc_id", "text"])
        back = bpe.decode(coded, PATH, ["doc_id", "text", "ids", "n_tokens"]).collect()
        assert len(back) == docs.count()
        for r in back:
            want = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
            assert r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)


def test_one_pass_equals_encoding_then_decoding(spark, texts):
    docs = texts.select("doc_id", "text", "ids", "hash")
    both = bpe.decode(bpe.encode(docs, PATH, ["doc_id", "text"]), PATH, ["doc_id", "text", "ids", "n_tokens"])
    once = bpe.recode(docs, PATH, ["doc_id", "text"])
    assert once.columns == both.columns and sorted(map(str, once.collect())) == sorted(map(str, both.collect()))
    assert bpe.recode(docs.limit(0), PATH, ["doc_id", "hash"]).count() == 0


def test_bpe_decodes_broken_bytes(spark, tokenizer):
    ids = [tokenizer.encode("é🎉").ids[k:] for k in range(3)]
    df = spark.createDataFrame([(k, np.array(x, "<u4").tobytes()) for k, x in enumerate(ids)] + [(9, None)], "k int, ids binary")
    got = dict(rows(bpe.decode(df, PATH, ["k"]), "k", "decoded"))
    assert got == {k: tokenizer.decode(x, skip_special_tokens=False) for k, x in enumerate(ids)} | {9: ""}


def test_codec_query(spark, tokenizer):
    got = {r["doc_id"]: r for r in queries.op2_bpe_codec(spark, SMALL).collect()}
    for r in table(spark, SMALL, "documents").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        row = got[r["doc_id"]]
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files_hold_all_documents(spark, texts, tokenizer, tmp_path):
    docs = texts.unionByName(texts.limit(0))
    token_files.write(docs, PATH, f"file://{tmp_path}/tokens", end_id=2)
    got = sorted(token_files.read(spark, f"file://{tmp_path}/tokens").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in texts.collect()], key=lambda i: (i is not None, i or 0))
    start = 0
    want = Counter()
    for r in texts.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    token_files.write(texts.limit(0), PATH, f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def test_stupid_backoff_by_hand(spark, texts):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "a b c"), (3, None), (4, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score(docs, ["doc_id"]).collect()}
    one, bi, tri = Counter(), Counter(), Counter()
    split = {1: "a b a b c".split(), 2: "a b c".split(), 3: [], 4: ["z"]}
    for w in split.values():
        one.update(w)
        bi.update(zip(w, w[1:]))
        tri.update(zip(w, w[1:], w[2:]))
    for i, w in split.items():
        total = 0.0
        for k, c in enumerate(w):
            if k > 1 and tri[w[k - 2], w[k - 1], c] >= 2:
                total += math.log(tri[w[k - 2], w[k - 1], c] / bi[w[k - 2], w[k - 1]])
            elif k > 0 and bi[w[k - 1], c] >= 2:
                total += math.log(bi[w[k - 1], c] / one[w[k - 1]]) + (math.log(0.4) if k > 1 else 0)
            else:
                total += math.log(one[c] / 9) + min(k, 2) * math.log(0.4)
        assert got[i]["n_words"] == len(w) and got[i]["lm_score"] == pytest.approx(total)
    assert lm_score.score(texts, ["doc_id", "score"]).count() == texts.count()
    assert lm_score.score(docs.limit(0), ["doc_id"]).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, texts):
    docs = texts.select("doc_id", "text").unionByName(table(spark, SMALL, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = simhash_golay.classes(docs, ["doc_id", "text"]).collect()
    prints = [brute_fingerprint(r["text"] or "") for r in got]
    assert [r["fp"] % 2**64 for r in got] == prints
    group = list(range(len(got)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(got)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                group[root(a)] = root(b)
    least = {}
    for k, r in enumerate(got):
        if r["doc_id"] is not None:
            least[root(k)] = min(least.get(root(k), r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in got] == [least.get(root(k)) for k in range(len(got))]
    assert simhash_golay.classes(docs.limit(0), ["doc_id"]).count() == 0


def test_golay_keys_meet_for_every_pattern_of_four_bits(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    flips = [sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (1, 2, 3, 4) for _ in range(10)]
    pairs = {(b, b ^ f) for b, f in zip(base, flips)}
    fps = np.array(sorted({x for p in pairs for x in p}), np.uint64).view(np.int64).tolist()
    links = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash_golay.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert {frozenset(p) for p in pairs} <= links


def test_line_chunks_on_edges(spark, texts):
    out = line_chunks.dedup(texts)
    assert out.count() == texts.count() and set(out.columns) == {*texts.columns, "n_cut"}
    assert dict(rows(out.where("doc_id IN (1, 2, 3, 5)"), "doc_id", "text")) == dict(rows(texts.where("doc_id IN (1, 2, 3, 5)"), "doc_id", "text"))
    body = "\n".join(f"shared line {k} of a long passage" for k in range(40))
    docs = spark.createDataFrame([(k, f"head {k}\nown {k}\n{body}\ntail {k}\nend {k}") for k in range(3)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_chunks.dedup(docs).collect()}
    assert got[0]["n_cut"] == 0 and got[1]["n_cut"] == got[2]["n_cut"] >= 20
    for k in (1, 2):
        left = got[k]["text"].split("\n")
        assert f"own {k}" in left and f"end {k}" in left and len(left) + got[k]["n_cut"] == 44
    assert line_chunks.dedup(docs.limit(0)).count() == 0


QUESTION = ("A baker named Tom sells 12 loaves in 3 hours every morning. How many loaves does the baker named Tom sell "
            "in 9 hours if every loaf weighs 2 kg and nothing is left over?")


def test_decontamination_catches_reparameterised_questions(spark, texts):
    other = QUESTION.replace("12", "15").replace("Tom", "Ann").replace("3 hours", "4 hours").replace("2 kg", "5 lb")
    broken = QUESTION.replace("named Tom sell in", "named Bob sell in")
    docs = spark.createDataFrame([(1, f"Some words before. {QUESTION} And after."), (2, f"Well then. {other}"), (3, f"Hm. {broken}"),
                                  (4, "The baker sells loaves in the morning and is happy."), (5, None), (None, QUESTION),
                                  (6, "Ann Bob Tom Ann Bob Tom 1 2 3 4 5 6 7 8 9 Ann Bob Tom")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1): "exact", (2, 1): "reparameterised", (None, 1): "exact"}
    wide = decontaminate.leaks(docs, bench, broadcast_rows=0)
    assert {(r["doc_id"], r["item_id"]): r["kind"] for r in wide.collect()} == got
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.clean(texts, bench).count() == texts.count()
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_short_items_are_searched_whole(spark):
    bench = spark.createDataFrame([(1, "seven little words make a short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see: Seven little words make a short item!"), (2, "seven little words")], "doc_id long, text string")
    assert rows(decontaminate.leaks(docs, bench), "doc_id", "item_id") == [(1, 1)]


def test_labelled_sample_keeps_to_its_bound_and_fold(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    sample = labelled_sample(docs, labels, "quality", 5, 0, 20)
    assert sample.count() <= 20
    assert sample.where(crc32_mod(F.col("doc_key"), 5) == 0).count() == 0


@pytest.mark.parametrize("module,label", [(quality_ftrl, "quality"), (toxicity, "toxic")])
def test_classifiers_on_edges(spark, texts, small_labels, module, label):
    for labels in (small_labels, small_labels.limit(0), small_labels.where(f"{label} = 1")):
        model = module.fit_documents(texts, labels)
        got = module.score(texts, model, ["doc_id", "lang"])
        scores = [r["score"] for r in got.collect()]
        assert len(scores) == texts.count() and all(0 <= s <= 1 for s in scores)
        assert module.score(texts.limit(0), model, ["doc_id"]).count() == 0


def held_out(spark, query, folder):
    got = query(spark, folder)
    return got.where("held_out").join(table(spark, folder, "labels"), "doc_id").toPandas()


def test_quality_on_held_out_rows(spark):
    x = held_out(spark, queries.op10_quality_ftrl, "/root/testdata/sf0.1")
    assert (x.predicted == x.quality).mean() > 0.97
    assert (x[x.quality == 1].predicted == 1).mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    x = held_out(spark, queries.op5_string_kernel_toxicity, "/root/testdata/sf0.1")
    assert x[x.predicted == 1].toxic.mean() > 0.9
    assert (x[x.toxic == 1].predicted == 1).mean() > 0.6


def test_string_kernel_tolerates_gaps_and_insertions():
    kernel = toxicity.Kernel(["idiot", "worthless"], toxicity.Settings())
    values = kernel.values(["idiot", "idixot", "worthxless", "the", "sentence", ""])
    assert values[0, 0] == pytest.approx(1, abs=1e-4) and values[1, 0] > 0.2 and values[2, 1] > 0.4 and values[3:].max() < 0.05
    slow = sum(0.8 ** ((c - a + 1) + (z - x + 1)) for a in range(5) for b in range(a + 1, 5) for c in range(b + 1, 5)
               for x in range(6) for y in range(x + 1, 6) for z in range(y + 1, 6)
               if ("idiot"[a], "idiot"[b], "idiot"[c]) == ("idixot"[x], "idixot"[y], "idixot"[z]))
    fast = toxicity.subsequence_kernel(toxicity.coded(["idiot"], 5), toxicity.coded(["idixot"], 6), 3, 0.8)[0, 0]
    assert fast == pytest.approx(slow, rel=1e-4)
    assert toxicity.units("I.d.i.o.t!") == ["idiot"] and toxicity.joined("you i d i o t s ok") == "you idiots ok"
