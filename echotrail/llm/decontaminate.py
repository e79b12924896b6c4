"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, names (capitalised words inside a sentence) and units after numbers turn into
typed placeholders, other words lose case and punctuation. Hashes of template windows of the benchmark meet those of
the documents in a hash join. Windows of one document and item with the same offset form a run; in it every slot's item
value must stand for one document value and the reverse, which tells a re-parameterised question from a text that just
shares the template. An item leaks if its consistent runs together, words put in or left out between them, hold enough of
its windows (`COVERAGE`) or reach enough of its tokens (`REACHED`), or if an unbroken run of `EXACT` tokens as written, or
of the whole item if it is shorter, stands in the document.

Template windows of the benchmark need at least half plain words; items that are mostly numbers and names are found by
windows of `WRITTEN` tokens as written (without case and punctuation), if they have that many. Items
shorter than the window are searched as wholes; items of fewer than `LEAST_TOKENS` tokens tell nothing and are passed
over. Documents are exploded inside the scan and only matches leave it: benchmark windows are broadcast up to
`BROADCAST_ROWS` (counted first), above that the join shuffles both sides. Null texts match nothing; repeated rows get
one result together; a null doc_id is reported as null. Other columns are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import let, settled

WINDOW, LEAST_TOKENS, COVERAGE, BROADCAST_ROWS = 8, 5, 0.5, 500_000
#: Tokens of a window of written tokens, of a run of them that is a leak, and the share of an item's tokens that is one.
WRITTEN, EXACT, REACHED = 10, 20, 0.75
#: Placeholders of numbers, names and units; private characters, each one token.
NUMBER, NAME, UNIT = "", "", ""
#: Unit words (fixed values).
UNITS = ("mm cm m km inch inches ft feet foot yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l "
         "liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week "
         "weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent degree degrees meter meters metre "
         "metres kilometer kilometers kilogram kilograms gram grams mph kmh watt watts volt volts").split()


def template_text(text: Column) -> Column:
    """The text with placeholders, lower case and no punctuation; every white-space token stays one token."""
    out = F.regexp_replace(text, r"(?<=[^\s.!?:]\s)\p{Lu}\p{Ll}[\p{L}'’-]*", NAME)
    out = F.lower(F.regexp_replace(out, r"\d+(?:[.,:/]\d+)*", NUMBER))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\s" + NUMBER + NAME + UNIT + "]+", "")
    units = f"(?<={NUMBER}\\s)(?:{'|'.join(UNITS)})(?!\\S)"
    return let(out, lambda t: F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, units, UNIT)).otherwise(t))


def tokens(text: Column) -> Column:
    """Structs (t, v) of template token and token as written, without those that hold punctuation alone."""
    both = F.arrays_zip(F.split(template_text(text), r"\s").alias("t"), F.split(text, r"\s").alias("v"))
    return F.filter(both, lambda x: x["t"] != "")


def plain(token: Column) -> Column:
    """A slot's value: lower case, without punctuation around it."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def window_hashes(words: Column, size: int) -> Column:
    """Hashes of all windows of so many template tokens, in order; none if there are fewer."""
    def of(hashes: Column) -> Column:
        starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(1), F.size(hashes) - (size - 1)))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda k: F.xxhash64(F.slice(hashes, k, size)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def written(text: Column) -> Column:
    """Tokens in lower case and without punctuation, numbers and names included."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), r"\s"), lambda x: x != "")


def item_windows(items: DataFrame) -> DataFrame:
    """Rows (item_id, size, at, hash) of items (item_id, w, said, size); windows of written tokens have a negative size."""
    rows = (items.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x["t"])))
            .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
            .withColumn("part", F.slice("w", F.col("at"), F.col("size")))
            .where(F.size(F.filter("part", lambda x: x["t"].isin(NUMBER, NAME, UNIT))) * 2 <= F.col("size"))
            .select("item_id", "size", "at", F.xxhash64(F.slice("hashes", F.col("at"), F.col("size"))).alias("hash")))
    plainly = items.select("item_id", F.posexplode(window_hashes(F.col("said"), WRITTEN)).alias("place", "hash"))
    return rows.unionByName(plainly.select("item_id", F.lit(-WRITTEN).alias("size"), (F.col("place") + 1).alias("at"), "hash"))


def longest(ats: Column) -> Column:
    """Length of the longest row of successive numbers."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, at: Column) -> Column:
        run = F.when(at == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(at.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(ats), start, step, lambda s: s["best"])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (doc_id, mark, item_id, n_windows, coverage, kind), one per document and leaked item; kind is `exact` or
    `reparameterised`; coverage is that of the item's windows, or of its tokens by a written run if that is more; mark
    (xxhash64 of the text) tells apart texts of one doc_id."""
    items = (benchmark.where("item_id is not null and text is not null")
             .select("item_id", tokens(F.col("text")).alias("w"), written(F.col("text")).alias("said"))
             .where(F.size("w") >= LEAST_TOKENS).withColumn("size", F.least(F.size("w"), F.lit(window))).cache())
    parts = item_windows(items).cache()
    measured = parts.agg(F.count("*"), F.collect_set("size")).first()
    totals = items.select("item_id", "w", F.size("said").alias("n_said")).join(
        parts.where("size > 0").groupBy("item_id").agg(F.count("*").alias("n_windows")), "item_id", "left")
    if measured[0] <= broadcast_rows:
        parts = F.broadcast(parts)
    words = F.filter(F.split(template_text(F.col("text")), r"\s"), lambda x: x != "")
    plain_docs = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("mark"))
    worded, said = plain_docs.withColumn("words", words), plain_docs.withColumn("words", written(F.col("text")))
    # a window's row carries no text: whole texts are read again for the few documents that may leak
    found = [(worded if size > 0 else said).select("doc_id", "mark", F.posexplode(window_hashes(F.col("words"), abs(size))).alias("place", "hash"))
             .withColumn("size", F.lit(size)).join(parts, ["hash", "size"]) for size in sorted(measured[1] or [window])]
    found = reduce(DataFrame.unionByName, found)
    runs = found.groupBy("doc_id", "mark", "item_id", "size", (F.col("place") + 1 - F.col("at")).alias("offset")).agg(
        F.collect_set("at").alias("ats"))
    pairs = runs.groupBy("doc_id", "mark", "item_id").agg(
        F.collect_list(F.struct("size", "offset", "ats")).alias("all")).join(totals, "item_id")
    pairs = pairs.withColumn("runs", F.filter("all", lambda r: r["size"] > 0)).withColumn(
        "length", F.aggregate(F.filter("all", lambda r: r["size"] < 0), F.lit(0), lambda n, r: F.greatest(n, longest(r["ats"]) + (WRITTEN - 1))))
    tokens_of = lambda r: F.flatten(F.transform(r["ats"], lambda a: F.sequence(a, a + r["size"] - 1)))
    held = lambda rs: F.size(F.array_distinct(F.flatten(F.transform(rs, lambda r: r["ats"]))))
    reached = lambda rs: F.size(F.array_distinct(F.flatten(F.transform(rs, tokens_of))))
    enough = lambda rs: (F.size(rs) > 0) & ((held(rs) >= coverage * F.col("n_windows")) | (reached(rs) >= REACHED * F.size("w")))
    copied = (F.col("length") > 0) & (F.col("length") >= F.least(F.lit(EXACT), F.col("n_said")))
    pairs = settled(pairs.where(copied | enough(F.col("runs"))).drop("all"), "leak-pairs")
    asked = settled(pairs.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "leak-documents")
    same_text = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    few = asked.count() <= broadcast_rows
    whole = plain_docs.join(F.broadcast(asked) if few else asked, same_text, "left_semi").dropDuplicates(["doc_id", "mark"])
    pairs = pairs.join(whole.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "text"), same_text).drop("__id", "__mark")

    def slots(own: Column, r: Column) -> Column:
        places = F.filter(F.array_distinct(tokens_of(r)), lambda p: F.element_at("w", p)["t"].isin(NUMBER, NAME, UNIT))
        return F.array_distinct(F.transform(places, lambda p: F.struct(
            F.element_at("w", p)["t"].alias("kind"), plain(F.element_at("w", p)["v"]).alias("item"),
            plain(F.element_at(own, p + r["offset"])["v"]).alias("doc"))))

    def judged(r: Column, s: Column) -> Column:
        values = lambda side: F.size(F.array_distinct(F.transform(s, lambda x: F.struct(x["kind"], x[side]))))
        return F.struct(r["size"].alias("size"), r["ats"].alias("ats"), ((values("item") == F.size(s)) & (values("doc") == F.size(s))).alias("ok"),
                        F.forall(s, lambda x: x["item"] == x["doc"]).alias("same"))

    runs = let(tokens(F.col("text")), lambda own: F.transform("runs", lambda r: let(slots(own, r), lambda s: judged(r, s))))
    pairs = pairs.select("doc_id", "mark", "item_id", "w", "n_windows", "n_said", "length", F.filter(runs, lambda r: r["ok"]).alias("runs"))
    exact = copied | enough(F.filter("runs", lambda r: r["same"]))
    share = F.greatest(F.coalesce(held(F.col("runs")) / F.col("n_windows"), F.lit(0.0)), F.when(copied, F.col("length") / F.col("n_said")).otherwise(0.0))
    return pairs.where(copied | enough(F.col("runs"))).select(
        "doc_id", "mark", "item_id", share.alias("coverage"), held(F.col("runs")).alias("n_windows"),
        F.when(exact, "exact").otherwise("reparameterised").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that leak an item; all columns stay."""
    bad = leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__mark")), "left_anti")
