"""Suffix-array dedup, vector codes and whitening against brute force."""

import collections
import hashlib
import math

import numpy as np
import pytest
from edge_rows import SMALL, texts  # noqa: F401

from echotrail.llm import queries, suffix_dedup, vector_codes, whitening
from echotrail.llm.common import table


def brute_spans(whole, length):
    """Removed spans of every text: unions of the windows that start at two places or more."""
    seen = collections.Counter(t[i:i + length] for t in whole for i in range(len(t) - length + 1))
    out = []
    for t in whole:
        spans = []
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def assert_like_brute_force(spark, rows, length, gram):
    df = spark.createDataFrame([(k, i, t, "x", 5, b"k") for k, (i, t) in enumerate(rows)],
                               "n long, doc_id long, text string, row string, id int, kept binary").repartition(3)
    got = {r["n"]: r for r in suffix_dedup.dedup(df.drop("kept"), ["n", "doc_id", "row", "id"], length, gram).collect()}
    whole = [(t or "").encode() for _, t in rows]
    for k, spans in enumerate(brute_spans(whole, length)):
        assert [tuple(s) for s in got[k]["spans"]] == spans
        kept = whole[k]
        for a, b in reversed(spans):
            kept = kept[:a] + kept[b:]
        assert bytes(got[k]["kept"]) == kept and got[k]["n_bytes"] == len(whole[k])
        assert (got[k]["doc_id"], got[k]["row"], got[k]["id"]) == (rows[k][0], "x", 5)


def passages(n):
    """Documents of random words that share one passage between different neighbours, and one of several variants."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), 5)) for _ in range(400)]
    some = lambda k: " ".join(rng.choice(words, k))
    shared, halves = some(14), [some(9) for _ in range(3)]
    return [(k, f"{some(rng.integers(0, 12))}{shared}{some(rng.integers(0, 12))}{halves[k % 3][:30 + k % 20]}{some(5)}") for k in range(n)]


@pytest.mark.parametrize("shard", [4_000, 3])
def test_repeated_strings_on_edges(spark, texts, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "SPREAD", shard)  # three: keys span several shards, whose windows are merged
    monkeypatch.setattr(suffix_dedup, "SLICE", 40)
    rows = [(r["doc_id"], r["text"]) for r in texts.where("doc_id IS NULL OR doc_id <> 5").collect()]
    rows += passages(40) + [(90, "ab" * 300), (91, "ba" * 100), (92, "ab" * 24), (93, "z" * 49), (94, "z" * 50), (95, "z" * 51)]
    assert_like_brute_force(spark, rows, 50, 12)
    if shard == 3:
        assert suffix_dedup.dedup(texts.limit(0), ["doc_id"]).count() == 0


def test_anchors_do_not_depend_on_how_bytes_are_cut(monkeypatch):
    whole = [t.encode() for _, t in passages(60)]
    data, ends = np.frombuffer(b"".join(whole), np.uint8), np.cumsum([len(t) for t in whole])
    rows = lambda: np.concatenate([np.stack(r) for r in suffix_dedup.anchors(data, ends, 50, 12)], axis=1)
    want = rows()
    for step in (64, 500):
        monkeypatch.setattr(suffix_dedup, "STEP", step)
        assert (rows() == want).all()
    alone = [next(suffix_dedup.anchors(np.frombuffer(t, np.uint8), np.array([len(t)]), 50, 12)) for t in whole]
    monkeypatch.setattr(suffix_dedup, "STEP", 1 << 20)
    assert (np.concatenate([a[1] for a in alone]) == want[1]).all() and (np.concatenate([a[3] for a in alone]) == want[3]).all()


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (1, 30, 200, 7)] + [b"a" * 60, b"abc" * 40]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    words = suffix_dedup.words_at(data)
    order = suffix_dedup.suffix_array(words)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:] + b"\0" * 8)
    shared = suffix_dedup.common_prefixes(words, order, np.cumsum(sizes) - sizes, sizes, 25)
    for a, b in zip(order[:-1], order[1:], strict=True):
        same = next((k for k in range(25) if raw[a + k:a + k + 1] != raw[b + k:b + k + 1] or max(a, b) + k >= len(raw)), 25)
        assert shared[b] == same
    assert shared[order[0]] == 0


# Vector codes ---------------------------------------------------------------------------------------------------------


def usable(rows):
    return [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(256 * np.array([r[1] for r in kept], np.float32).astype(float)).astype(int)
    d = x.shape[1] // parts
    cut = [x[:, p * d:(p + 1) * d].tolist() for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p])) for v in cut[p]] for p in range(parts)]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v for v, f in zip(cut[p], found[p], strict=True) if f[1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    out = [(r[0], [found[p][k][1] for p in range(parts)], sum(found[p][k][0] for p in range(parts)), r[2]) for k, r in enumerate(kept)]
    text = ",".join(str(c) for book in books for e in book for c in e)
    errors = collections.Counter()
    for r in out:
        errors[r[3]] += r[2]
    return [(*r[:3], errors[r[3]]) for r in out], hashlib.sha256(text.encode()).hexdigest()


BAD = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [None] * 8, 1), (903, [float("inf")] + [0.0] * 7, 2), (904, [], 1), (905, [1.0] * 6, 1),
       (906, [1e30] * 8, 1)]


def test_codes_on_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=8) / 4], [None, 1, 2][k % 3]) for k in range(70)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 2), (None, rows[5][1], None)]  # repeated ids and rows
    rows += [(100 + k, [round(v * 4) / 4 for v in rows[k][1]], 2) for k in range(30)]  # ties
    df = spark.createDataFrame([(*r, 1.0, "c") for r in rows + BAD], "vec_id long, embedding array<float>, label int, error double, code string")
    coded, books = vector_codes.compress(df, 256, 4, 9, 2)
    want, digest = brute_codes(rows, 4, 9, 2)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["vec_id"], r["codes"], r["error"], r["label_error"]) for r in coded.collect()], key=order) == sorted(want, key=order)
    assert vector_codes.fingerprint(books) == digest
    few, small = vector_codes.compress(df.where("vec_id < 2"), 256, 4, 64, 2)  # fewer vectors than entries
    assert few.count() == 2 and small.shape[1] == 2 and few.agg({"error": "sum"}).first()[0] == 0
    none, _ = vector_codes.compress(df.limit(0))
    assert none.count() == 0
    back = vector_codes.decoded(coded, books).where("vec_id = 50").first()
    assert len(back["restored"]) == 8 and np.abs(np.array(back["restored"]) - rows[50][1]).max() < 0.7


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(4)
    for dims in (1, 3, 4):
        part, entries = rng.integers(-6, 7, (400, dims)), rng.integers(-6, 7, (30, dims))
        index, best = vector_codes.nearest(part, entries)
        every = ((part[:, None] - entries[None]) ** 2).sum(2)
        assert (best == every.min(1)).all() and (index == every.argmin(1)).all()


# Whitening ------------------------------------------------------------------------------------------------------------


def brute_whitening(rows):
    kept = usable(rows)
    x = [tuple(math.floor(64 * float(np.float32(v))) + 1_000_000 for v in r[1]) for r in kept]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    near = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(near.T @ near / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (np.array(x, float) - np.array(sums) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    far = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return kept, n, far, white, values


def assert_like_eigh(got, rows, components):
    kept, n, far, white, values = brute_whitening(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, components + 1))
    for c, found in by.items():
        want = sorted(zip([r[0] for r in kept], far, white[:, c - 1], strict=True))
        found = sorted(found, key=lambda r: (r["vec_id"], r["deviation"]))
        assert [(r["vec_id"], r["deviation"], r["n"]) for r in found] == [(w[0], w[1], n) for w in want]
        a, b = np.array([r["whitened"] for r in found]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert abs(found[0]["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
        assert 0 <= found[0]["identity_error"] < 1e-9


def test_whitening_on_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=8) * np.arange(1, 9) / 3 + k % 4).tolist(), 0) for k in range(300)]
    rows += [(300, rows[0][1], 0), (0, rows[0][1], 1)]  # equal vectors count once in the fit, rows stay
    schema = "vec_id long, embedding array<float>, label int, n double, component string"
    df = spark.createDataFrame([(*r, 1.0, "c") for r in rows + BAD], schema)
    assert_like_eigh(whitening.whiten(df).collect(), rows, 8)
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.where("vec_id = 7")).collect()  # no direction at all
    assert len(one) == 8 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in one)
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 0, 1.0, "c") for k in range(5)], schema)  # one direction of two
    flat = whitening.whiten(line).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: r["component"])] == [False] * 5 + [True] * 5
    assert max(abs(r["identity_error"]) for r in flat) < 1e-12


def test_whitening_of_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], 0) for r in table(spark, SMALL, "embeddings").collect()]
    assert_like_eigh(queries.QUERIES["op13_refined_whitening"](spark, SMALL).collect(), rows, 16)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 1e-7], [2, 0, 0, 0, 0], [1, 1, 1, 1, 1]])
def test_refinement_reaches_double_precision(values):
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(5, 5)).astype(float))[0]
    a = (q * np.array(values, float)) @ q.T * 1e6
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    exact = np.linalg.eigvalsh(a)[::-1]
    assert np.abs(found - exact).max() < 1e-9 * 1e6 * max(values)
    assert np.abs(x.T @ x - np.eye(5)).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 3e-15 * 1e6 * max(values) * 5
