"""Data-quality report: one row per rule with its violation count.

The reference declares UNIQUE / NOT NULL in DDL, checks role/decision lists
in code and enforces no foreign keys. Here every rule is a count over a
whole table: enumerations and NOT NULLs of one table share one aggregate
(one scan), the unique keys of a table share one grouped count of (rule, key)
pairs, and all children of a parent share one left-anti join, after their
keys have been counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.functions.labels import DECISIONS, ROLES, SOLUSI, STATUSES

UNIQUE_KEYS = [("users", "id"), ("users", "username"), ("products", "id"), ("products", "kode_barang"),
               ("tickets", "id"), ("tickets", "ticket_no"), ("service_vouchers", "voucher_no"),
               ("service_vouchers", "qr_token"), ("settings", "key")]
NOT_NULL = [("schedules", "ticket_id"), ("schedules", "teknisi_id"), ("visit_results", "ticket_id"),
            ("visit_results", "teknisi_id"), ("notifications", "message"), ("users", "username"),
            ("products", "kode_barang"), ("tickets", "ticket_no"),
            ("users", "name"), ("users", "role"), ("products", "nama_produk"), ("activity_log", "action"),
            ("debug_logs", "type"), ("approval_logs", "ticket_id"), ("approval_logs", "action"),
            ("service_vouchers", "voucher_no"), ("service_vouchers", "ticket_id"),
            ("service_vouchers", "customer_name"), ("service_vouchers", "qr_token"), ("settings", "value")]
IN_LIST = [("users", "role", ROLES, False), ("tickets", "status", STATUSES, False),
           ("tickets", "management_decision", DECISIONS, True), ("visit_results", "solusi", SOLUSI, True)]
ORPHANS = [("tickets", "product_id", "products", "id"), ("tickets", "created_by", "users", "id"),
           ("schedules", "ticket_id", "tickets", "id"), ("schedules", "teknisi_id", "users", "id"),
           ("visit_results", "ticket_id", "tickets", "id"), ("activity_log", "ticket_id", "tickets", "id"),
           ("approval_logs", "ticket_id", "tickets", "id"), ("notifications", "user_id", "users", "id"),
           ("service_vouchers", "ticket_id", "tickets", "id"), ("tickets", "approved_by", "users", "id"),
           ("tickets", "closed_by", "users", "id"), ("visit_results", "teknisi_id", "users", "id"),
           ("activity_log", "user_id", "users", "id"), ("approval_logs", "user_id", "users", "id")]


def _keys(df: DataFrame, table: str, keys: list[tuple[str, str]]) -> DataFrame:
    """``table_name, rule, k``: one row per row of ``df`` and (rule, column) pair with a value (one scan)."""
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("k")) for rule, c in keys])
    return (df.select(F.explode(pairs).alias("_x")).where(F.col("_x.k").isNotNull())
            .select(F.lit(table).alias("table_name"), "_x.rule", "_x.k"))


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("table_name", "rule", "k").agg(F.count(F.lit(1)).alias("n"))


def _by_table(rules: list[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for t, *rest in rules:
        out.setdefault(t, []).append(tuple(rest))
    return out


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rule, violations`` for every rule whose tables are given (0 where it holds).

    A unique rule counts the rows of a value that occurs more than once; null
    values break neither it nor an orphan rule.
    """
    found: list[DataFrame] = []
    names: list[tuple[str, str]] = []
    for t, keys in _by_table(UNIQUE_KEYS).items():
        if t in tables:
            rules = [(f"unique:{k}", k) for k, in keys]
            names += [(t, rule) for rule, _ in rules]
            found.append(_counted(_keys(tables[t], t, rules)).where("n > 1"))
    checks: list[tuple] = [(t, f"not_null:{c}", F.col(c).isNull()) for t, c in NOT_NULL]
    for t, c, values, nullable in IN_LIST:
        bad: Column = ~F.coalesce(F.col(c).isin(*values), F.lit(False))
        checks.append((t, f"in_list:{c}", F.col(c).isNotNull() & bad if nullable else bad))
    for t, rules in _by_table(checks).items():
        if t in tables:
            names += [(t, rule) for rule, _ in rules]
            one = tables[t].agg(F.array(*[F.struct(F.lit(rule).alias("rule"), F.count_if(bad).alias("n"))
                                          for rule, bad in rules]).alias("_a"))
            found.append(one.select(F.explode("_a").alias("_x"))
                         .select(F.lit(t).alias("table_name"), "_x.rule", F.lit(None).cast("string").alias("k"), "_x.n"))
    for parent in sorted({r[2] for r in ORPHANS} & set(tables)):
        rules = [(child, f"orphan:{fk}->{parent}", fk) for child, fk, up, _ in ORPHANS if up == parent and child in tables]
        if not rules:
            continue
        names += [(child, rule) for child, rule, _ in rules]
        used = reduce(DataFrame.unionByName, [_keys(tables[c], c, own) for c, own in _by_table(rules).items()])
        known = tables[parent].select(F.col("id").cast("string").alias("k"))
        found.append(_counted(used).join(known, "k", "left_anti").select("table_name", "rule", "k", "n"))
    total = (reduce(DataFrame.unionByName, found).groupBy("table_name", "rule").agg(F.sum("n").alias("_n")))
    listed = next(iter(tables.values())).sparkSession.createDataFrame(names, "table_name string, rule string")
    return listed.join(total, ["table_name", "rule"], "left").select(
        "table_name", "rule", F.coalesce("_n", F.lit(0)).cast("long").alias("violations"))
