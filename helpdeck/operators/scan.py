"""Ordered prefix composition per key, as a tree of bounded groups.

Problem: apply a long, ordered list of events per key where each event's
effect depends on the state left by all earlier events (a ticket's status
guards). A per-key ``collect_list`` or ``Window.partitionBy(key)`` puts one
key's whole history in one task - unbounded for a hot key.

When the state is a small finite set (ticket status: 7 values), each event
is a *transition table* ``t: state -> state`` (an ``array<int>``), and
applying events one after another is table composition, which is
associative. Associativity allows a tree reduction (the parallel prefix
scan):

* up pass: events are grouped by ``(key, rank >> 6)`` - at most 64 events per
  group, whatever the key's size - and each group folds its sorted members
  into one table, remembering each member's *exclusive* prefix inside the
  group; groups are grouped again by ``>> 6`` until every key has one root.
* down pass: a node's global prefix is its parent's global prefix followed
  by its own in-group prefix - one small join per level.

Every shuffle moves groups of at most 64 rows, every join is on
``(key, bucket)``; a key holding a third of all events is spread over as
many tasks as any other third of the data. Counters that do not depend on
the state (here: follow-up increments) ride along as sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT_BITS = 6  # 64 members per group


def identity_table(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def compose(first: Column, then: Column) -> Column:
    """Table of 'apply ``first``, then ``then``' (0-based state indices)."""
    return F.transform(first, lambda s: F.get(then, s))


def _fold_group(members: Column, n: int) -> Column:
    """Fold a sorted array<struct<ck, t, inc>> into struct<t, inc, pre: array<struct<ck, p, i>>>
    where ``pre`` holds each member's exclusive prefix inside the group."""
    init = F.struct(identity_table(n).alias("t"), F.lit(0).cast("long").alias("inc"),
                    F.array().cast("array<struct<ck:bigint,p:array<int>,i:bigint>>").alias("pre"))

    def step(acc, x):
        rec = F.struct(x["ck"].alias("ck"), acc["t"].alias("p"), acc["inc"].alias("i"))
        return F.struct(compose(acc["t"], x["t"]).alias("t"), (acc["inc"] + x["inc"]).alias("inc"),
                        F.concat(acc["pre"], F.array(rec)).alias("pre"))

    return F.aggregate(members, init, step)


def _levels_needed(max_rank: int | None) -> int:
    levels, span = 1, 1 << FANOUT_BITS
    while max_rank is not None and max_rank > span:
        levels += 1
        span <<= FANOUT_BITS
    return levels


def prefix_scan(df: DataFrame, key: str, seq: str, table: str, inc: str, n_states: int) -> DataFrame:
    """Add ``prefix`` (composition of all earlier events' tables of the same
    key, identity for the first) and ``inc_before`` (sum of ``inc`` of
    earlier events) to every row. ``seq`` orders the events of a key and
    must be unique within it.

    The tree is built on each event's dense rank within its key (computed by
    range partitioning, so a hot key is ranked by many tasks); every level-0
    group then holds 64 consecutive events of one key.
    """
    from helpdeck.operators.changes import sequence_numbers

    ranked = sequence_numbers(df, [seq], partition=[key], name="_r")
    max_rank = ranked.agg(F.max("_r")).first()[0]   # reads the checkpointed numbering
    levels = _levels_needed(max_rank)
    # level 0 children are the events themselves, keyed by rank - 1
    nodes = ranked.select(F.col(key).alias("_k"), (F.col("_r") - 1).alias("ck"),
                          F.col(table).alias("t"), F.col(inc).cast("long").alias("inc"))
    ups: list[DataFrame] = []
    for _ in range(levels):
        grouped = (nodes.withColumn("b", F.shiftright("ck", FANOUT_BITS))
                   .groupBy("_k", "b")
                   .agg(F.array_sort(F.collect_list(F.struct("ck", "t", "inc"))).alias("m"))
                   .withColumn("f", _fold_group(F.col("m"), n_states)))
        # in-group exclusive prefixes of this level's children
        ups.append(grouped.select("_k", "b", F.explode("f.pre").alias("x"))
                   .select("_k", "b", F.col("x.ck").alias("ck"), F.col("x.p").alias("p"), F.col("x.i").alias("i")))
        nodes = grouped.select("_k", F.col("b").alias("ck"), F.col("f.t").alias("t"), F.col("f.inc").alias("inc"))
    # down pass: the single root per key has an identity prefix
    glob = nodes.select("_k", "ck", identity_table(n_states).alias("gp"), F.lit(0).cast("long").alias("gi"))
    for lvl in range(levels - 1, -1, -1):
        parent = glob.select("_k", F.col("ck").alias("b"), "gp", "gi")
        child = ups[lvl].join(parent, ["_k", "b"])
        glob = child.select("_k", "ck", compose(F.col("gp"), F.col("p")).alias("gp"),
                            (F.col("gi") + F.col("i")).alias("gi"))
    res = glob.select(F.col("_k").alias(key), (F.col("ck") + 1).alias("_r"), F.col("gp").alias("prefix"),
                      F.col("gi").alias("inc_before"))
    return ranked.join(res, [key, "_r"]).drop("_r")
