"""How five document filters interact: an existential self-join and counts of failure combinations.

A to D are conditions of one text.  E (an earlier document has the same text)
is an existential self-join: a left-semi join on the texts' hash, the exact
text and a smaller ``doc_id``.  Its ids are united with the ids of the other
failures, each row's failures become one of 32 combinations, and the
combinations are counted per part.  Everything about the 120 orders is then
arithmetic on 32 counts per part, so no order ever meets a document.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import WS, WS_CHARS, written

#: Fixed by the contract: the filters' letters, their limits and the signs of D.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SIGNS = 200, 50, 3, "[#$%&*|]"
#: Hashes are thinned out to so many slots before they are broadcast, whatever the corpus: the bound of that broadcast.
SLOTS = 1 << 20
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}
MASKS = 1 << len(FILTERS)


def own_failures(rows: DataFrame) -> DataFrame:
    """``rows`` with ``bits`` instead of ``text`` (not null): the filters A to D that it fails."""
    inner = F.btrim("text", F.lit(WS_CHARS))
    keep = [c for c in rows.columns if c != "text"]
    d = rows.withColumn("words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WS}]+", -1)))
    d = d.select(*keep, F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("n_distinct"),
                 F.regexp_count("text", F.lit("[A-Z]")).alias("upper"), F.char_length("text").alias("chars"),
                 F.col("text").rlike(SIGNS).alias("signs"))
    fails = {"A": F.col("n") < MIN_WORDS, "B": 100 * F.col("n_distinct") < MIN_DISTINCT_PCT * F.col("n"),
             "C": 100 * F.col("upper") > MAX_UPPER_PCT * F.col("chars"), "D": F.col("signs")}
    return d.select(*keep, sum((F.when(c, BITS[f]).otherwise(0) for f, c in fails.items()), F.lit(0)).alias("bits"))


def earlier_copies(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``doc_id, part, h1, h2`` of the rows whose text some smaller ``doc_id`` has too.

    Only texts whose hash comes with two ids are moved: their hashes are thinned out to at most
    ``SLOTS`` slots (what shares a slot goes along and drops out at the join).  A group of copies
    is one row per text on the joined side (its least id, aggregated and written before); the
    other side may be split anywhere, since each of its rows is looked up by itself.
    """
    twice = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    twice = written(twice.select("h1", "h2"), "audit-repeated")
    slots = twice.select(F.pmod("h1", F.lit(SLOTS)).alias("slot")).distinct()
    texts = (docs.withColumn("slot", F.pmod("h1", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi")
             .select("doc_id", "part", "h1", "h2", "text"))
    copies = written(texts.join(twice, ["h1", "h2"], "left_semi").select(texts.columns), "audit-copies")
    least = written(copies.groupBy("h1", "h2", "text").agg(F.min("doc_id").alias("least")).select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("text").alias("same"), "least"), "audit-least")
    return copies.join(least, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("text") == F.col("same"))
                       & (F.col("least") < F.col("doc_id")), "left_semi").select("doc_id", "part", "h1", "h2")


def failures(docs: DataFrame, part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``part, doc_id, mask, n``: how many rows of that part and id fail the filters of ``mask`` (bit ``i``: filter ``i``).

    Rows with the same id, part and text are counted together.  A null text is an empty text (so it
    may be the copy of one), a null part the part ``''``.  A null id is smaller than none and none
    is smaller than it: such a row neither fails E nor makes another one fail it.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.hash("text"))
    own = written(own_failures(rows), "audit-own")
    copies = earlier_copies(rows, own)
    union = own.withColumn("n", F.lit(1)).unionByName(
        copies.distinct().withColumn("bits", F.lit(BITS["E"])).withColumn("n", F.lit(0)))
    return union.groupBy("doc_id", "h1", "h2", "part").agg(
        F.expr("bit_or(bits)").alias("mask"), F.sum("n").cast("long").alias("n")).select("part", "doc_id", "mask", "n")


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, counts, good, toxic``: arrays with one count per combination of failures.

    A document is good (toxic) if any of its rows in ``labels`` says so; one without a row is neither.
    """
    flags = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                         F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    flags = flags.where("doc_id is not null").withColumnRenamed("doc_id", "labelled")
    per = (failed.join(flags, F.col("doc_id") == F.col("labelled"), "left").groupBy("part", "mask")
           .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("g"),
                F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t")))
    table = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(MASKS)])
    return per.groupBy("part").agg(table("n").alias("counts"), table("g").alias("good"), table("t").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``part, filter_order, step`` and what that step does in that order, for every part, order and step.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, gone before), ``unique_fails``
    (fail its filter only), ``good_lost`` and ``toxic_lost`` among the removed, ``shapley``: the filter's
    removals summed over all orders (of the documents with f failures, each filter is the first one in
    1/f of the orders).  An empty table gives no rows; other columns are ignored.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = combinations(failures(docs, part_col, text_col), labels).select(
        "*", F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.element_at(
        F.array(*[F.lit(BITS[f]) for f in FILTERS]), F.instr(F.lit(FILTERS), letter))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda acc, i: F.when(
        i < F.col("step"), acc + bit(F.substring("filter_order", i, F.lit(1)))).otherwise(acc))
    rows = rows.withColumn("mine", bit(letter)).withColumn("past", before)
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def total(values: str, test, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: F.when(
            test(m), acc + F.get(F.col(values), m) * weight(m)).otherwise(acc))

    fails = lambda m: m.bitwiseAND(F.col("mine")) != 0
    gone = lambda m: m.bitwiseAND(F.col("past")) != 0
    here = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part", "filter_order", "step",
        total("counts", lambda m: ~gone(m) & ~fails(m)).alias("kept"), total("counts", here).alias("removed"),
        total("counts", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("counts", lambda m: m == F.col("mine")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("counts", fails, lambda m: F.floor(F.lit(len(orders)) / F.greatest(F.bit_count(m), F.lit(1)))).alias("shapley"))
