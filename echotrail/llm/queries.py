"""The registered queries of the subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.llm import (
    bpe, decontaminate, line_chunks, lm_score, quality_ftrl, simhash_golay, suffix_dedup, token_files, toxicity, url_filter, vector_codes,
    vector_dedup, whitening,
)
from echotrail.llm.common import crc32_mod, table
from echotrail.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> str:
    """Path of the public vocabulary file; its folder's module is not imported before it is needed."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op1_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Words and stupid-backoff score of every document, by trigram counts over all documents."""
    scored = lm_score.score(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    return scored.select("doc_id", "n_words", F.round("lm_score", 4).alias("lm_score"))


ORACLES["op1_stupid_backoff"] = f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS n, unnest(w) AS c FROM split),
grams AS (
  SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY n) AS b, lag(c, 2) OVER (PARTITION BY doc_id ORDER BY n) AS a FROM words),
one AS (SELECT c, count(*) AS k FROM grams GROUP BY c),
two AS (SELECT b, c, count(*) AS k FROM grams WHERE n > 1 GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS k FROM grams WHERE n > 2 GROUP BY a, b, c),
valued AS (
  SELECT g.doc_id,
    CASE WHEN g.n > 2 AND three.k >= {lm_score.MIN_COUNT} THEN ln(three.k / before.k)
         WHEN g.n > 1 AND two.k >= {lm_score.MIN_COUNT} THEN ln(two.k / prior.k) + CASE WHEN g.n > 2 THEN ln({lm_score.BACKOFF}) ELSE 0 END
         ELSE ln(one.k / (SELECT sum(k) FROM one)) + least(g.n - 1, 2) * ln({lm_score.BACKOFF}) END AS v
  FROM grams g JOIN one ON g.c = one.c LEFT JOIN two ON g.b = two.b AND g.c = two.c
    LEFT JOIN three ON g.a = three.a AND g.b = three.b AND g.c = three.c
    LEFT JOIN one prior ON g.b = prior.c LEFT JOIN two before ON g.a = before.b AND g.b = before.c)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, round(coalesce(v.v, 0), 4) AS lm_score
FROM split s LEFT JOIN (SELECT doc_id, sum(v) AS v FROM valued GROUP BY doc_id) v ON s.doc_id = v.doc_id"""


@query
def op2_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    back = bpe.recode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary(), ["doc_id"])
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Number of links and component of every vector."""
    return vector_dedup.classes(table(spark, folder, "embeddings"), cosine=0.93)


ORACLES["op3_vector_dedup"] = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a AS root, b AS node FROM links UNION SELECT r.root, l.b FROM reach r JOIN links l ON r.node = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT root, min(node) AS m FROM reach GROUP BY root)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.root"""


@query
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Start, length and checksum of every document, read back from the token files."""
    target = scratch_path(spark, "token-files")
    token_files.write(table(spark, folder, "documents").select("doc_id", "text"), vocabulary(), target, end_id=2)
    return token_files.read(spark, target)


@query
def op5_string_kernel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document; labels come from rows with crc32(doc_id) mod 3 <> 1 alone."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_documents(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"], threshold=0.7)
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that leak a benchmark item, exact or with other numbers, names and units."""
    found = decontaminate.leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "coverage", "kind")


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict for the URL of every page."""
    model = url_filter.fit(url_filter.labelled_urls(spark))
    judged = url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), model, ["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op8_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_golay.classes(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op9_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the line chunks that stand earlier in the corpus."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = line_chunks.dedup(docs)
    return cut.select("doc_id", "n_cut", "text")


ORACLES["op9_line_chunks"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total
  FROM documents WHERE text IS NOT NULL),
rolled AS (
  SELECT *, md5(coalesce(lag(md5(line)) OVER (PARTITION BY doc_id ORDER BY n), '') || md5(line)) AS h FROM lines),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN n = total OR ('0x' || substr(h, 1, 6))::INT % {line_chunks.MEAN_LINES} = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM rolled),
chunks AS (
  SELECT doc_id, part, min(n) AS first_line, count(*) AS size, string_agg(line, chr(10) ORDER BY n) AS chunk
  FROM numbered GROUP BY doc_id, part),
cut AS (
  SELECT doc_id, part FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first_line) AS copy
    FROM chunks WHERE size >= {line_chunks.LEAST_LINES}) WHERE copy > 1),
remade AS (
  SELECT n.doc_id, sum(CASE WHEN c.part IS NULL THEN 0 ELSE 1 END)::INT AS n_cut,
         coalesce(string_agg(n.line, chr(10) ORDER BY n.n) FILTER (WHERE c.part IS NULL), '') AS text
  FROM numbered n LEFT JOIN cut c ON n.doc_id = c.doc_id AND n.part = c.part GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(r.n_cut, 0)::INT AS n_cut, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text
FROM documents d LEFT JOIN remade r ON d.doc_id = r.doc_id"""


@query
def op10_quality_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; labels come from rows with crc32(doc_id) mod 5 <> 0 alone."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_ftrl.fit_documents(docs, table(spark, folder, "labels"))
    scored = quality_ftrl.score(docs, model, ["doc_id"], threshold=0.3)
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op11_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document covered by a repeated string of 200 bytes, and the digest of the others."""
    cut = suffix_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"], length=200)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_suffix_array_dedup"] = """
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS w FROM (SELECT r, h, unnest(range(len(h) // 2 - 199)) AS p FROM numbered)),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, p FROM windows WHERE w IN (FROM often)),
marked AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
spans AS (SELECT r, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
kept AS (
  SELECT n.r, string_agg(CASE WHEN g.b IS NULL THEN substr(n.h, 2 * g.a + 1) ELSE substr(n.h, 2 * g.a + 1, 2 * (g.b - g.a)) END, '' ORDER BY g.a) AS h
  FROM gaps g JOIN numbered n ON g.r = n.r GROUP BY n.r),
counts AS (SELECT r, count(*) AS n FROM spans GROUP BY r)
SELECT n.doc_id, (len(n.h) // 2)::BIGINT AS n_bytes, ((len(n.h) - len(coalesce(k.h, n.h))) // 2)::BIGINT AS n_removed,
       coalesce(c.n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, n.h))) AS kept_sha256
FROM numbered n LEFT JOIN kept k ON n.r = k.r LEFT JOIN counts c ON n.r = c.r"""


@query
def op12_equal_average_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, by product codebooks of 16 parts and 64 entries."""
    coded, books = vector_codes.compress(table(spark, folder, "embeddings"), scale=256, parts=16, entries=64, rounds=2)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """SQL twin of op12: each round is one step of common table expressions."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
  SELECT id, part, min(struct_pack(d := list_sum(list_transform(list_zip(xs, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := entry)) AS hit
  FROM parts JOIN book{k} USING (part) GROUP BY id, part)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT part, entry, list(m ORDER BY j) AS c FROM (
    SELECT p.part, n.hit.e AS entry, j, floor(sum(p.xs[j])::DOUBLE / count(*))::BIGINT AS m
    FROM parts p JOIN near{k} n ON p.id = n.id AND p.part = n.part, (SELECT unnest(range(1, (SELECT len(any_value(xs)) FROM parts) + 1)) AS j)
    GROUP BY p.part, n.hit.e, j) GROUP BY part, entry),
book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT id, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS xs
  FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS (SELECT part, id - 1 AS entry, xs AS c FROM parts WHERE id <= {entries}),{','.join(steps)},
coded AS (
  SELECT id, string_agg(lower(printf('%02x', hit.e)), '' ORDER BY part) AS code, sum(hit.d)::BIGINT AS error FROM near{rounds} GROUP BY id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS s FROM book{rounds}),
sums AS (SELECT k.label, sum(c.error)::BIGINT AS label_error FROM kept k JOIN coded c ON k.id = c.id GROUP BY k.label)
SELECT k.vec_id, c.code, c.error, s.label_error, (SELECT s FROM book) AS codebooks_sha256
FROM kept k JOIN coded c ON k.id = c.id JOIN sums s ON k.label IS NOT DISTINCT FROM s.label"""


ORACLES["op12_equal_average_codes"] = _codes_sql()


@query
def op13_refined_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened coordinates of every vector on the 16 leading components of the distinct vectors."""
    return whitening.whiten(table(spark, folder, "embeddings"), scale=64, shift=1_000_000, components=16)
