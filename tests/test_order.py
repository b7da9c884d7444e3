"""Lists come in their stated order (the oracle check compares rows as sets)."""

import pytest

from helpdeck.plans import QUERIES

SF = "/root/testdata/sf0.001"

# query -> (column, descending) by precedence; text compares by code point
ORDERS = {
    "products_sorted": [("nama_produk", False), ("id", False)],
    "user_directory": [("role", False), ("name", False), ("id", False)],
    "latest_logs": [("id", True)],
    "tickets_filter": [("id", True)],
    "approval_history": [("created_at", True), ("id", True)],
    "activity_timeline": [("ticket_id", False), ("created_at", False), ("id", False)],
    "technician_history": [("teknisi_id", False), ("created_at", True), ("id", True)],
    "pending_approval": [("created_at", True), ("id", True)],
    "processed_approvals": [("updated_at", True), ("id", True)],
    "approval_queue": [("created_at", True), ("id", True)],
    "calendar_month": [("tanggal", False), ("jam", False), ("id", False)],
    "role_inbox": [("is_read", False), ("created_at", True), ("id", True)],
    "top_products": [("total", True), ("product_id", False)],
    "top_issues": [("total", True), ("keluhan", False)],
    "technician_visits": [("total_visit", True), ("teknisi_id", False)],
    "dead_letter": [("failed_at", True), ("id", True)],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) > 1
    want = list(rows)
    for col, desc in reversed(ORDERS[name]):     # stable sorts, last key first; NULLs lowest
        want.sort(key=lambda r: (r[col] is not None, r[col] if r[col] is not None else 0), reverse=desc)
    assert rows == want
