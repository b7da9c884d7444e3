"""Projections, filters and predicates.

Filters are plain ``df.filter`` folds, so Catalyst pushes them to the scan;
IN-subqueries are written as ``left_semi`` / ``left_anti`` joins directly
(no NULL-aware anti join, which Spark can only plan as a broadcast nested
loop).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.functions._util import as_col

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def ascii_lower(c) -> Column:
    """Fold only A-Z to a-z (SQLite LIKE folds ASCII only: 'É' stays unequal to 'é')."""
    return F.translate(as_col(c), _UPPER, _LOWER)


def sqlite_like(c, pattern: str) -> Column:
    """SQLite ``x LIKE pattern``: ASCII case-insensitive, ``%``/``_`` wildcards, no escape.

    Spark's LIKE treats ``\\`` as the escape character, so every backslash of
    the pattern is doubled to stay literal.
    """
    pat = pattern.lower() if pattern.isascii() else "".join(
        ch.lower() if ch in _UPPER else ch for ch in pattern)
    pat = pat.replace("\\", "\\\\")
    return ascii_lower(c).like(pat)


def contains_like(c, needle: str) -> Column:
    """B5 ``x LIKE '%needle%'`` where the caller's ``%`` and ``_`` stay wildcards."""
    return sqlite_like(c, f"%{needle}%")


def tickets_open(tickets: DataFrame, closed=("completed", "rejected")) -> DataFrame:
    """B3 open tickets: status NOT IN the closed list (a NULL status is dropped, as in SQL)."""
    return tickets.filter(~F.col("status").isin(*closed))


def active_technicians(users: DataFrame) -> DataFrame:
    """B2 technicians that are active, as (id, name)."""
    return users.filter((F.col("role") == "teknisi") & (F.col("active") == 1)).select("id", "name")


def user_directory(users: DataFrame, roles=("admin", "management", "teknisi", "cs")) -> DataFrame:
    """B1 + F2 staff directory columns, by role then name."""
    return (users.filter(F.col("role").isin(*roles))
            .select("id", "username", "name", "phone", "email", "role")
            .orderBy("role", "name", "id"))


def tickets_handled(tickets: DataFrame, visits: DataFrame) -> DataFrame:
    """C6 ``id IN (SELECT ticket_id FROM visit_results)`` as a semi join."""
    return tickets.join(visits.select(F.col("ticket_id").alias("id")), "id", "left_semi")


def tickets_unhandled(tickets: DataFrame, visits: DataFrame) -> DataFrame:
    """C7 no visit row and status not 'rejected' (NULL status dropped)."""
    v = visits.filter(F.col("ticket_id").isNotNull()).select(F.col("ticket_id").alias("id"))
    return tickets.join(v, "id", "left_anti").filter(~F.col("status").isin("rejected"))


def tickets_by_technician(tickets: DataFrame, schedules: DataFrame, teknisi_id) -> DataFrame:
    """C6 ``id IN (SELECT ticket_id FROM schedules WHERE teknisi_id = ?)``."""
    s = schedules.filter(F.col("teknisi_id") == F.lit(teknisi_id)).select(F.col("ticket_id").alias("id"))
    return tickets.join(s, "id", "left_semi")


def tickets_filter(enriched: DataFrame, schedules: DataFrame | None = None, visits: DataFrame | None = None,
                   *, status: str | None = None, produk: str | None = None, marketplace: str | None = None,
                   customer: str | None = None, kota: str | None = None, teknisi=None,
                   penanganan: str | None = None) -> DataFrame:
    """B8 optional-filter search over enriched tickets (``tickets_enriched``).

    Each given argument adds one predicate; absent or empty ones add none.
    Newest id first.
    """
    df = enriched
    if status and status != "all":
        df = df.filter(F.col("status") == status)
    for colname, needle in (("nama_produk", produk), ("marketplace", marketplace),
                            ("customer_name", customer), ("customer_kota", kota)):
        if needle:
            df = df.filter(contains_like(colname, needle))
    if teknisi not in (None, ""):
        df = tickets_by_technician(df, schedules, teknisi)
    if penanganan == "sudah":
        df = tickets_handled(df, visits)
    elif penanganan == "belum":
        df = tickets_unhandled(df, visits)
    return df.orderBy(F.desc("id"))


def tickets_by_creator(tickets: DataFrame, k: int | None = 20, creator=None) -> DataFrame:
    """F6 a creator's tickets, newest first, capped at ``k`` (None = all).

    Re-aimed for a whole table: every creator's newest k at once. The
    per-key limit plans as a WindowGroupLimit, which trims each map task to
    k rows per creator *before* the shuffle, so a creator owning a third of
    all tickets still ships only k rows per task.
    """
    from pyspark.sql import Window

    df = tickets.select("id", "ticket_no", "customer_name", "status", "created_at", "created_by")
    if creator is not None:
        df = df.filter(F.col("created_by") == F.lit(creator))
    if k is None:
        return df.orderBy("created_by", F.desc("created_at"), F.desc("id"))
    w = Window.partitionBy("created_by").orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
