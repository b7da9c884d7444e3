"""Message delivery log analytics and the
failed-login limiter in batch (2.10 J2, exact form).

A delivery log row is one send attempt: (id, ts, address, message, ok). A
*message* is its phone plus its text: sends run at the same time, so attempts
of several messages to one phone interleave in the log. The phone is compared
as the sender dials it (``normalize_phone``; the raw text where that is NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helpdeck.functions.dates import epoch_seconds, epoch_text
from helpdeck.functions.text import normalize_phone
from helpdeck.operators.pieces import cut, running
from helpdeck.operators.sequence import hour_bucket, reset_scan

TS_TEXT = "yyyy-MM-dd HH:mm:ss"

MAX_FAILED_LIST = 50      # fixed value: failed-message list length
LIMIT_FAILURES = 10       # fixed value: failed logins per period
LIMIT_PERIOD_SECONDS = 15 * 60  # fixed value: limiter period


def delivery_outcome(attempts: DataFrame) -> DataFrame:
    """E7 one row per message (address, message): attempts made, first/last
    attempt time and whether any attempt succeeded. A partial aggregate: a
    message with a third of the log moves one row per map task."""
    return (normalized_address(attempts).groupBy("address", "message")
            .agg(F.count(F.lit(1)).alias("attempts"), (F.max("ok") == 1).alias("delivered"),
                 F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_at"),
                 F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at")))


def delivery_summary(outcomes: DataFrame) -> DataFrame:
    """D18 ok / failed / total messages per day of the first attempt."""
    return (outcomes.groupBy(F.substring("first_at", 1, 10).alias("day"))
            .agg(F.count_if(F.col("delivered")).alias("ok"),
                 F.count_if(~F.col("delivered")).alias("failed"),
                 F.count(F.lit(1)).alias("total")))


def _entry_steps(attempts: DataFrame) -> DataFrame:
    """Every attempt as a step of its message's pile: ``ts, id, address, message, _up`` (a failure adds an entry, a success
    takes the newest one away), ``_level`` (between which heights it steps) and ``_p`` (piece of the log).

    Heights are running sums of +1 and -1 (``pieces.running``, so a message with a third of the log is as many tasks as there
    are pieces). On one level ups and downs alternate: the step before a success there is the failure whose entry it takes.
    """
    d = (normalized_address(attempts.filter(normalize_phone(F.col("address").cast("string")).isNotNull()))
         .select("ts", "id", "address", "message", (F.col("ok") != 1).alias("_up")))
    d = running(cut(d, ["ts", "id"]), ["address", "message"], ["ts", "id"], {"_h": ("sum", F.when(F.col("_up"), 1).otherwise(-1))})
    return d.withColumn("_level", F.when(F.col("_up"), F.col("_h") + 1).otherwise(F.col("_h"))).drop("_h")


def _left_on(steps: DataFrame) -> DataFrame:
    """``id, ts, address, message`` of the entries that no success took away: a level's last step is a failure."""
    last = steps.groupBy("address", "message", "_level").agg(F.max(F.struct("ts", "id", "_up")).alias("x"))
    return last.filter("x._up").select("x.id", "x.ts", "address", "message")


def failed_entries(attempts: DataFrame) -> DataFrame:
    """Failed attempts whose entry no later success took away, as (id, ts, address, message); no limit of entries.

    Every failed attempt adds an entry of its phone and text (a phone that does
    not normalise adds none); a success takes the newest such entry away, if there is one.
    """
    return _left_on(_entry_steps(attempts))


def dead_letter(attempts: DataFrame, k: int = MAX_FAILED_LIST) -> DataFrame:
    """E5 the failed list as the sender keeps it: newest first, never more than ``k`` entries; where one more
    is added, the oldest is dropped for good.

    An entry is dropped when ``k`` newer ones are on the list at once. That depends on the entries added after it only,
    so: the newest ``k`` entries that no success took away are the candidates (there are no others), and for each of them
    the number of newer entries on the list is followed through the log, as a sum and a highest point per piece, which
    add up piece by piece. Removal compares normalised phones on both sides (the reference compares the raw phone;
    documented difference).
    """
    steps = _entry_steps(attempts)
    newest = _left_on(steps).orderBy(F.desc("ts"), F.desc("id")).limit(k)
    found = sorted((r["ts"], r["id"]) for r in newest.select("ts", "id").collect())   # k rows at most
    if not found:
        return newest.select("id", "address", "message", F.date_format("ts", TS_TEXT).alias("failed_at"))
    dropped = _dropped(steps, found, k)
    if dropped:
        ts, i = found[dropped - 1]
        newest = newest.filter((F.col("ts") > F.lit(ts)) | ((F.col("ts") == F.lit(ts)) & (F.col("id") > i)))
    return newest.orderBy(F.desc("ts"), F.desc("id")).select("id", "address", "message", F.date_format("ts", TS_TEXT).alias("failed_at"))


def _dropped(steps: DataFrame, found: list[tuple], k: int) -> int:
    """How many of the candidates ``found`` (ascending) were dropped: the oldest ones, up to the last that ever had ``k`` newer entries above it."""
    pair = lambda t, i: F.struct(t.alias("ts"), i.alias("id"))
    marks = F.array(*[pair(F.lit(t), F.lit(i).cast(steps.schema["id"].dataType)) for t, i in found])
    taken = running(steps, ["address", "message", "_level"], ["ts", "id"], {"_of": ("last", F.struct("ts", "id", "_up"))})
    entry = F.when(F.col("_up"), pair(F.col("ts"), F.col("id"))).when(F.col("_of._up"), pair(F.col("_of.ts"), F.col("_of.id")))
    tail = taken.withColumn("_entry", entry).filter(F.col("_entry") > F.get(marks, F.lit(0)))
    # an entry counts for the candidates before it: the first ``_above`` of them
    tail = tail.select("ts", "id", "_p", F.when(F.col("_up"), 1).otherwise(-1).alias("_d"),
                       F.size(F.filter(marks, lambda m: m < F.col("_entry"))).alias("_above"))
    w = Window.partitionBy("_p").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = len(found)
    step = [F.when(F.col("_above") > j, F.col("_d")).otherwise(0) for j in range(n)]
    tail = tail.select("_p", *[x.alias(f"_d{j}") for j, x in enumerate(step)], *[F.sum(x).over(w).alias(f"_h{j}") for j, x in enumerate(step)])
    pieces = tail.groupBy("_p").agg(F.array(*[F.sum(f"_d{j}") for j in range(n)]).alias("total"),
                                    F.array(*[F.max(f"_h{j}") for j in range(n)]).alias("top")).orderBy("_p").collect()
    height, top = [0] * n, [0] * n
    for piece in pieces:  # one row a piece, MAX_PIECES at most
        for j in range(n):
            top[j] = max(top[j], height[j] + piece["top"][j])
            height[j] += piece["total"][j]
    return max((j + 1 for j in range(n) if top[j] >= k), default=0)


def normalized_address(df: DataFrame, col: str = "address") -> DataFrame:
    """Address key as the failed list stores it: ``normalizePhone(x) || x``."""
    raw = F.col(col).cast("string")
    return df.withColumn(col, F.coalesce(normalize_phone(raw), raw))


def burst_failures(attempts: DataFrame, threshold: int = LIMIT_FAILURES,
                   period_seconds: int = LIMIT_PERIOD_SECONDS, bucket_seconds: int = 60) -> DataFrame:
    """J2 exact limiter, batch: per address and fixed period, failures since
    the last success; a period is *blocked* once that count reaches
    ``threshold``. While blocked nothing more is counted, so ``n`` saturates
    at ``threshold``; ``tenth_at`` is the time of the blocking failure.
    Returns blocked periods only.
    """
    p = F.floor(epoch_seconds(F.col("ts")) / F.lit(period_seconds)).cast("long")
    d = attempts.withColumn("period", p)
    scanned = reset_scan(d, ["address", "period"], ["ts", "id"], F.col("ok") == 1,
                         hour_bucket(F.col("ts"), bucket_seconds))
    fails = scanned.filter(F.col("ok") != 1).withColumn("run_fail", F.col("before") + 1)
    return (fails.groupBy("address", "period")
            .agg(F.least(F.max("run_fail"), F.lit(threshold)).cast("long").alias("n"),
                 F.min(F.when(F.col("run_fail") == threshold, F.col("ts"))).alias("_tenth"))
            .filter(F.col("_tenth").isNotNull())
            .select("address",
                    epoch_text(F.col("period") * period_seconds)
                    .alias("period_start"),
                    "n", F.date_format("_tenth", "yyyy-MM-dd HH:mm:ss").alias("tenth_at")))


def burst_failures_simple(attempts: DataFrame, threshold: int = LIMIT_FAILURES,
                          period_seconds: int = LIMIT_PERIOD_SECONDS) -> DataFrame:
    """J2 simple form (the stream's batch twin): failures per address in a
    tumbling period, reported when at least ``threshold``; no reset on success."""
    p = F.floor(epoch_seconds(F.col("ts")) / F.lit(period_seconds)).cast("long")
    return (attempts.filter(F.col("ok") != 1).groupBy("address", p.alias("period"))
            .agg(F.count(F.lit(1)).alias("failures"))
            .filter(F.col("failures") >= threshold)
            .select("address",
                    epoch_text(F.col("period") * period_seconds)
                    .alias("period_start"), "failures"))
