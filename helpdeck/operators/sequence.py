"""Reset-counter scan per key without sending a whole key to one task.

Several service-desk rules are sequential per key: a delivery attempt run
ends at the first success (E7), the login limiter counts failures since the
last success (J2). A plain ``Window.partitionBy(key).orderBy(ts)`` puts every
row of a key in one task - with a key holding a third of all rows, that task
holds a third of the data.

``reset_scan`` splits each key's timeline into buckets and works in two
phases:

1. *Local*: one window per (key, bucket) - a small slice of a key - gives
   each row its position since the last reset **inside the bucket**, and a
   per-bucket summary (resets, non-reset rows, trailing non-reset rows).
2. *Carry*: a window over the **summary** (one row per bucket, not per
   event) combines earlier buckets into the carry each bucket starts with.
   The carry is joined back on (key, bucket); the rows are already hash
   partitioned on those columns, so only the small summary moves.

The combine is the associative monoid of "count since last reset", so the
result equals a sequential pass over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reset_scan(df: DataFrame, keys: list[str], order: list[str], is_reset: Column,
               bucket: Column) -> DataFrame:
    """Add, per row, within its key in ``order``:

    * ``before``  - non-reset rows since the last reset, strictly before this row
    * ``resets_before`` - reset rows strictly before this row

    ``is_reset`` is a boolean Column; ``bucket`` a Column monotone in
    ``order`` (e.g. ``hour_bucket(ts)``) that splits each key.
    """
    r = F.when(is_reset, 1).otherwise(0)
    d = df.withColumn("_r", r).withColumn("_b", bucket)
    kb = keys + ["_b"]
    w_excl = Window.partitionBy(*kb).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = (d.withColumn("_nr_excl", F.coalesce(F.sum(1 - F.col("_r")).over(w_excl), F.lit(0)))
          .withColumn("_rs_excl", F.coalesce(F.sum("_r").over(w_excl), F.lit(0)))
          .withColumn("_nr_at_last_reset",
                      F.last(F.when(F.col("_r") == 1, F.col("_nr_excl")), ignorenulls=True).over(w_excl))
          .withColumn("_before_local", F.col("_nr_excl") - F.coalesce(F.col("_nr_at_last_reset"), F.lit(0))))

    # per-bucket summary: resets, non-reset rows, trailing non-reset rows after the last reset
    last = F.max_by(F.struct(F.col("_r").alias("r"), F.col("_before_local").alias("bl")),
                    F.struct(*[F.col(c) for c in order]))
    summ = (d.groupBy(*kb).agg(F.sum("_r").alias("_n_r"), F.sum(1 - F.col("_r")).alias("_n_nr"),
                               last.alias("_last"))
            .withColumn("_post", F.when(F.col("_last.r") == 1, F.lit(0)).otherwise(F.col("_last.bl") + 1))
            .drop("_last"))
    wk_excl = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wk_incl = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    summ = (summ.withColumn("_cum_nr_incl", F.sum("_n_nr").over(wk_incl))
                .withColumn("_cum_nr_excl", F.col("_cum_nr_incl") - F.col("_n_nr"))
                .withColumn("_has", F.col("_n_r") > 0)
                .withColumn("_lr_cum", F.last(F.when(F.col("_has"), F.col("_cum_nr_incl")), ignorenulls=True)
                            .over(wk_excl))
                .withColumn("_lr_post", F.last(F.when(F.col("_has"), F.col("_post")), ignorenulls=True)
                            .over(wk_excl))
                .withColumn("_carry", F.when(F.col("_lr_cum").isNull(), F.col("_cum_nr_excl"))
                            .otherwise(F.col("_lr_post") + F.col("_cum_nr_excl") - F.col("_lr_cum")))
                .withColumn("_resets_carry", F.coalesce(F.sum("_n_r").over(wk_excl), F.lit(0)))
                .select(*kb, "_carry", "_resets_carry"))
    out = d.join(summ, kb)
    before = F.when(F.col("_rs_excl") == 0, F.col("_carry") + F.col("_before_local")).otherwise(F.col("_before_local"))
    return (out.withColumn("before", before.cast("long"))
               .withColumn("resets_before", (F.col("_resets_carry") + F.col("_rs_excl")).cast("long"))
               .drop("_r", "_b", "_nr_excl", "_rs_excl", "_nr_at_last_reset", "_before_local", "_carry",
                     "_resets_carry"))


def hour_bucket(ts: Column, seconds: int = 3600) -> Column:
    """Time bucket of ``seconds`` width (a TIMESTAMP or TIMESTAMP_NTZ column)."""
    from helpdeck.functions.dates import epoch_seconds

    return F.floor(epoch_seconds(ts) / F.lit(seconds)).cast("long")
