"""Quality and I/O queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from helpdeck.functions.labels import DECISIONS, ROLES, SOLUSI, STATUSES
from helpdeck.operators import quality as Q
from helpdeck.plans.catalog import query, views
from helpdeck.session import scratch_path
from helpdeck.sources import io as IO

SNAPSHOT_TABLES = ["tickets", "products", "users", "schedules", "visit_results", "notifications", "activity_log",
                   "approval_logs", "service_vouchers", "settings", "debug_logs"]


def _tables(v) -> dict:
    return {t: getattr(v, t) for t in SNAPSHOT_TABLES}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The tables' declarations, stated apart from the operator's lists.
_DECLARED_UNIQUE = {"users": "id username", "products": "id kode_barang", "tickets": "id ticket_no",
                    "service_vouchers": "voucher_no qr_token", "settings": "key"}
_DECLARED_NOT_NULL = {
    "users": "username name role", "products": "kode_barang nama_produk", "tickets": "ticket_no",
    "schedules": "ticket_id teknisi_id", "visit_results": "ticket_id teknisi_id", "notifications": "message",
    "activity_log": "action", "debug_logs": "type", "approval_logs": "ticket_id action",
    "service_vouchers": "voucher_no ticket_id customer_name qr_token", "settings": "value"}
_REFERS = {
    "tickets": {"schedules": "ticket_id", "visit_results": "ticket_id", "activity_log": "ticket_id",
                "approval_logs": "ticket_id", "service_vouchers": "ticket_id"},
    "users": {"tickets": "created_by approved_by closed_by", "schedules": "teknisi_id", "visit_results": "teknisi_id",
              "activity_log": "user_id", "approval_logs": "user_id", "notifications": "user_id"},
    "products": {"tickets": "product_id"}}


def _constraint_sql() -> str:
    parts = []
    for t, cols in _DECLARED_UNIQUE.items():
        parts += [f"SELECT {_q(t)} AS table_name, {_q('unique:' + c)} AS rule, (SELECT count(*) FROM {t} WHERE {c} IN "
                  f"(SELECT {c} FROM {t} GROUP BY {c} HAVING count({c}) >= 2)) AS violations" for c in cols.split()]
    for t, cols in _DECLARED_NOT_NULL.items():
        parts += [f"SELECT {_q(t)}, {_q('not_null:' + c)}, count(*) - count({c}) FROM {t}" for c in cols.split()]
    for t, c, values, null_breaks in (("users", "role", ROLES, 1), ("tickets", "status", STATUSES, 1),
                                      ("tickets", "management_decision", DECISIONS, 0), ("visit_results", "solusi", SOLUSI, 0)):
        good = f"count(*) FILTER ({c} IN ({', '.join(map(_q, values))}))"
        parts.append(f"SELECT {_q(t)}, {_q('in_list:' + c)}, count({'*' if null_breaks else c}) - {good} FROM {t}")
    for parent, children in _REFERS.items():
        parts += [f"SELECT {_q(t)}, {_q(f'orphan:{c}->{parent}')}, count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN "
                  f"(SELECT id FROM {parent} WHERE id IS NOT NULL)" for t, cols in children.items() for c in cols.split()]
    return "\n" + "\nUNION ALL\n".join(parts) + "\n"


@query("constraint_report", _constraint_sql())
def constraint_report(spark, sf_dir):
    return Q.constraint_report(_tables(views(spark, sf_dir)))


_COUNTS = "\nUNION ALL\n".join(f"SELECT {_q(t)} AS table_name, count(*) AS rows FROM {t}" for t in SNAPSHOT_TABLES)


@query("snapshot_export", _COUNTS)
def snapshot_export(spark, sf_dir):
    """A6: export every table to a new snapshot folder in the shared
    checkpoint location; the result is the manifest read back from storage."""
    root = IO.snapshot_export(_tables(views(spark, sf_dir)))
    return IO.snapshot_manifest(spark, root, SNAPSHOT_TABLES)


_RESTORE = "\nUNION ALL\n".join(
    f"SELECT {_q(t)} AS table_name, true AS readable, true AS schema_ok, "
    + ("(SELECT count(*) FROM users)" if t == "users" else "CAST(NULL AS BIGINT)")
    + " AS rows, true AS restorable" for t in SNAPSHOT_TABLES)


@query("snapshot_restore_check", _RESTORE)
def snapshot_restore_check(spark, sf_dir):
    """A7: export, then validate the written snapshot before it may be restored."""
    tables = _tables(views(spark, sf_dir))
    root = IO.snapshot_export(tables)
    expected = {t: df.schema for t, df in tables.items()}
    return IO.snapshot_restore_check(spark, root, expected)


def _sum_of(table: str) -> str:
    return "length(key)" if table == "settings" else "id"


_RESTORED = "\nUNION ALL\n".join(
    f"SELECT {_q(t)} AS table_name, count(*) AS rows, CAST(COALESCE(sum({_sum_of(t)}), 0) AS BIGINT) AS id_sum FROM {t}" for t in SNAPSHOT_TABLES)


@query("snapshot_restore", _RESTORED)
def snapshot_restore(spark, sf_dir):
    """A7: a set of tables of which half the rows are gone is replaced by a snapshot of the whole tables; a snapshot that lacks its marker is
    refused then and changes nothing. The result is what a reader of the published set finds."""
    tables = _tables(views(spark, sf_dir))
    expected = {t: df.schema for t, df in tables.items()}
    base = scratch_path(spark, "restored")
    IO.publish_set({t: df.filter(f"{_sum_of(t)} % 2 = 0") for t, df in tables.items()}, base)
    IO.snapshot_restore(spark, IO.snapshot_export(tables), expected, base)
    try:
        IO.snapshot_restore(spark, scratch_path(spark, "no-snapshot"), expected, base)
    except IO.RestoreRefused:
        pass
    now = IO.read_published_set(spark, base)
    parts = [now[t].agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.expr(_sum_of(t))), F.lit(0)).cast("long").alias("id_sum"))
             for t in SNAPSHOT_TABLES]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)
