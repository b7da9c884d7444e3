"""Scans over an ordered log, cut into pieces by its order.

A rule that needs "what came before" of each row of a long log must not put a
key (or the whole log) into one task. Here the log is cut at fixed points of
its order: the cut points come from a bounded sample (the rows with the
smallest hashes of their order, at most ``SAMPLE`` to a piece) and are literals
of the plan, so a row's piece is a pure function of the row. Nothing has to be
written or checkpointed for the pieces to be the same in every stage, and a
lost executor recomputes the same pieces.

Each scan then has two phases: windows within (key, piece), and windows over
one summary row per (key, piece), whose result is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 64       # sampled rows to a piece
MAX_PIECES = 256
_GROUP = 16       # cut points are looked up in two steps: group, then place in it


def cut_points(df: DataFrame, order: list[str], pieces: int | None = None) -> list[tuple]:
    """Ascending values of ``order`` at which the log is cut (at most ``MAX_PIECES - 1``; none for a small one)."""
    n = min(pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_PIECES)
    rows = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(n * SAMPLE).collect()
    points = sorted({tuple(r) for r in rows if None not in tuple(r)})
    step = max(len(points) // n, SAMPLE // 4)
    return points[step::step][:MAX_PIECES - 1]


def piece_of(df: DataFrame, order: list[str], points: list[tuple]) -> Column:
    """Number of the piece that a row belongs to: the cut points at or before it (a NULL order: the first piece)."""
    if not points:
        return F.pmod(F.xxhash64(*order), F.lit(1)).cast("int")  # 0, but a value of the row: joins by piece stay equi-joins
    types = [df.schema[c].dataType for c in order]

    def point(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(values, types))])

    groups = [points[i:i + _GROUP] for i in range(0, len(points), _GROUP)]
    me = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    heads = F.array(*[point(g[0]) for g in groups])
    lists = F.array(*[F.array(*[point(p) for p in g]) for g in groups])
    at = F.size(F.filter(heads, lambda h: h <= me))
    inside = F.size(F.filter(F.get(lists, at - 1), lambda p: p <= me))
    return F.coalesce(F.when(at == 0, 0).otherwise((at - 1) * _GROUP + inside), F.lit(0))


def cut(df: DataFrame, order: list[str], pieces: int | None = None, name: str = "_p") -> DataFrame:
    """``df`` with its piece number as column ``name``. ``order`` is to be unique and not NULL."""
    return df.withColumn(name, piece_of(df, order, cut_points(df, order, pieces)))


def running(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]], piece: str = "_p") -> DataFrame:
    """``df`` (cut, see ``cut``) with running totals over the earlier rows of the same key, the row itself excluded.

    ``totals``: new column -> (``sum`` | ``min`` | ``max`` | ``last``, expression); ``last`` is the latest value that is
    not NULL. Sums start at 0, the others are NULL where nothing came before. ``keys`` are not NULL.
    """
    keys = list(keys)
    d = df if keys else df.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    ends = F.struct(*[F.col(c) for c in order])
    within = Window.partitionBy(*by, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    for i, (_, expr) in enumerate(totals.values()):
        d = d.withColumn(f"_x{i}", expr)
    own, aggs, carry = [], [], []
    for i, (kind, _) in enumerate(totals.values()):
        x = F.col(f"_x{i}")
        own.append(fold[kind](x).over(within).alias(f"_o{i}"))
        aggs.append((F.max_by(x, F.when(x.isNotNull(), ends)) if kind == "last" else fold[kind](x)).alias(f"_s{i}"))
        carry.append(fold[kind](F.col(f"_s{i}")).over(earlier).alias(f"_c{i}"))
    d = d.select("*", *own)
    heads = d.groupBy(*by, piece).agg(*aggs).select(*by, piece, *carry)
    out = d.join(heads, [*by, piece])
    for i, (name, (kind, _)) in enumerate(totals.items()):
        o, c = F.col(f"_o{i}"), F.col(f"_c{i}")
        both = {"sum": F.coalesce(o, F.lit(0)) + F.coalesce(c, F.lit(0)), "min": F.least(o, c), "max": F.greatest(o, c),
                "last": F.coalesce(o, c)}[kind]
        out = out.withColumn(name, both)
    n = range(len(totals))
    return out.drop("_all", *[f"_{x}{i}" for i in n for x in "xosc"])
