"""Change application: transitions, imports, numbering, deletes, vouchers, constraints."""

import random
import re

from pyspark.sql import functions as F

from helpdeck import schemas as S
from helpdeck.operators import changes as CH
from helpdeck.operators import quality as Q

NOW = "2024-05-01 08:00:00"


def _ticket(**kw):
    base = {"follow_up_count": 0, "created_at": "2024-01-01 00:00:00", "updated_at": "2024-01-01 00:00:00"}
    base.update(kw)
    return base


def test_transitions_order_and_guards(spark):
    t = S.rows(spark, S.TICKETS, [
        _ticket(id=1, status="waiting", ticket_no="SC-2024-000001"),
        _ticket(id=2, status="scheduled", management_decision="Servis", approved_by=5),
        _ticket(id=3, status="completed"),
        _ticket(id=4, status="approval")])
    ch = S.rows(spark, S.CHANGES, [
        {"seq": 1, "ticket_id": 1, "kind": "analysis", "text": "cek", "ts": "t1", "user_id": 9},
        {"seq": 2, "ticket_id": 1, "kind": "approve", "decision": "Servis", "text": "ok", "ts": "t2", "user_id": 7},
        {"seq": 3, "ticket_id": 1, "kind": "reset", "ts": "t3", "user_id": 7},          # status waiting -> allowed
        {"seq": 4, "ticket_id": 1, "kind": "followup", "text": None, "ts": "t4", "user_id": 9},
        {"seq": 5, "ticket_id": 2, "kind": "reset", "ts": "t5", "user_id": 7},          # from scheduled: refused
        {"seq": 6, "ticket_id": 3, "kind": "calendar_schedule", "teknisi_id": 2, "tanggal": "01/05/2024",
         "jam": "10:00", "ts": "t6", "user_id": 9},                                     # from completed: no change
        {"seq": 7, "ticket_id": 4, "kind": "approve", "decision": "Bogus", "ts": "t7", "user_id": 7},  # invalid
        {"seq": 8, "ticket_id": 99, "kind": "close", "ts": "t8", "user_id": 1}])      # unknown ticket
    out = {r.id: r for r in CH.apply_transitions(t, ch).collect()}
    assert len(out) == 4
    a = out[1]
    assert a.status == "approval"
    assert a.admin_analysis == "cek\n[Follow-up #1] " + CH.DEFAULT_FOLLOWUP_NOTE
    assert (a.management_decision, a.management_comment, a.approved_by, a.approved_at) == (None, None, None, None)
    assert a.follow_up_count == 1 and a.updated_at == "t4"
    b = out[2]
    assert (b.status, b.management_decision, b.approved_by, b.updated_at) == ("scheduled", "Servis", 5,
                                                                             "2024-01-01 00:00:00")
    assert (out[3].status, out[3].updated_at) == ("completed", "2024-01-01 00:00:00")
    assert out[4].status == "approval"
    ev = CH.emit_events(t, ch).collect()
    kinds = sorted((r.target, r.seq) for r in ev)
    # calendar schedule is logged although its status change was refused; the refused reset writes nothing
    assert ("activity_log", 6) in kinds and ("activity_log", 5) not in kinds and ("activity_log", 7) not in kinds
    reset_log = [r for r in ev if r.target == "approval_logs" and r.seq == 3][0]
    assert (reset_log.old_status, reset_log.new_status, reset_log.decision) == ("waiting", "approval", "")


def test_unknown_tickets_still_write_their_rows(spark):
    t = S.rows(spark, S.TICKETS, [_ticket(id=1, status="waiting", ticket_no="SC-2024-000001", created_by=3)])
    rows = [("analysis", {}), ("followup", {}), ("reset", {}), ("approve", {"decision": "Servis"}), ("reject", {}),
            ("calendar_schedule", {"teknisi_id": 2, "tanggal": "a", "jam": "b"}), ("schedule", {}), ("close", {})]
    ch = S.rows(spark, S.CHANGES, [{"seq": i, "ticket_id": 77, "kind": k, "ts": "x", "user_id": 9, **more}
                                   for i, (k, more) in enumerate(rows)])
    ev = CH.emit_events(t, ch).collect()
    # follow-up and reset look for the ticket first; the schedule without its values is refused for any ticket
    assert sorted(r.seq for r in ev if r.target == "activity_log") == [0, 3, 4, 5, 7]
    assert sorted((r.seq, r.old_status, r.new_status) for r in ev if r.target == "approval_logs") == [
        (3, "approval", "waiting"), (4, "approval", "rejected")]
    users = S.rows(spark, S.USERS, [{"id": 1, "role": "cs"}, {"id": 2, "role": "admin"}])
    n = CH.emit_notifications(t, ch, users, S.rows(spark, S.SCHEDULES, [])).collect()
    assert sorted((r.seq, r.user_id, r.role) for r in n if r.seq < 3) == [(0, None, "management")]
    assert [r.message for r in n if r.seq == 4 and r.user_id == 1] == ["Ticket #77 ditolak Management"]
    assert CH.apply_transitions(t, ch).collect() == t.collect()


def test_followups_are_numbered_in_order(spark):
    t = S.rows(spark, S.TICKETS, [_ticket(id=1, follow_up_count=2, admin_analysis="a"), _ticket(id=2, follow_up_count=None)])
    ch = S.rows(spark, S.CHANGES, [{"seq": s, "ticket_id": 1, "kind": "followup", "text": f"n{s}", "ts": f"t{s}"} for s in (5, 3)])
    r = CH.followup_apply(t, ch).collect()
    assert [(x.id, x.status, x.follow_up_count, x.admin_analysis, x.updated_at) for x in r] == [
        (1, "approval", 4, "a\n[Follow-up #3] n3\n[Follow-up #4] n5", "t5")]


def test_schedule_replay_with_cancellations(spark):
    old = S.rows(spark, S.SCHEDULES, [{"id": 4, "ticket_id": 1, "teknisi_id": 6, "created_by": 1},
                                      {"id": 9, "ticket_id": 2, "teknisi_id": 6, "created_by": 1}])
    log = [(1, 1, "schedule", 2), (2, 2, "cancel_schedule", None), (3, 3, "calendar_schedule", 3), (4, 3, "cancel_schedule", None),
           (5, 2, "schedule", 5), (6, 2, "calendar_schedule", 7), (7, 2, "schedule", None), (8, 4, "close", None)]
    df = spark.createDataFrame([(s, t, k, tek, "2024-01-02", "10:00", "n", 100 + s, f"t{s}") for s, t, k, tek in log],
                               "seq long, ticket_id long, kind string, teknisi_id long, tanggal string, jam string, "
                               "notes string, user_id long, ts string")
    got = sorted((r.id, r.ticket_id, r.teknisi_id, r.created_by, r.created_at) for r in CH.schedule_replay(old, df).collect())
    # ticket 1 updated, ticket 2 deleted and inserted again by request 5, ticket 3 gone
    assert got == [(4, 1, 2, 1, None), (10, 2, 7, 105, "t5")]


def test_intake_keeps_given_numbers_and_columns(spark):
    raw = spark.createDataFrame([(1, "A", "k", "OWN-1", " x@y ", "/f"), (2, "B", "k", "", None, None), (3, "C", "", None, None, None),
                                 (4, "D", "k", None, None, None)],
                                "k long, customer_name string, keluhan string, ticket_no string, customer_email string, faktur_path string")
    for c, ty in [("tanggal_complaint", "string"), ("tanggal_pembelian", "string"), ("product_id", "long"), ("created_by", "long")]:
        raw = raw.withColumn(c, F.lit(None).cast(ty))
    got = sorted((r.id, r.ticket_no, r.customer_email, r.faktur_path, r.nomor_invoice)
                 for r in CH.ticket_intake(S.rows(spark, S.TICKETS, []), raw, NOW, ["k"]).collect())
    assert got == [(1, "OWN-1", "x@y", "/f", ""), (2, "SC-2024-000001", "", None, ""), (3, "SC-2024-000002", "", None, "")]


def test_transitions_keep_ticket_count(spark):
    t = S.rows(spark, S.TICKETS, [_ticket(id=i, status="waiting") for i in range(5)])
    ch = S.rows(spark, S.CHANGES, [{"seq": i, "ticket_id": i % 3, "kind": "close", "ts": "x", "user_id": 1}
                                   for i in range(10)])
    assert CH.apply_transitions(t, ch).count() == 5


def test_product_import(spark):
    p = S.rows(spark, S.PRODUCTS, [{"id": 5, "kode_barang": "A1", "nama_produk": "Old", "tipe": "t",
                                    "garansi_bulan": 1}])
    sheet = spark.createDataFrame(
        [(1, "A1", None, "First", None, "x", "12.5 bulan"), (2, "", " A1 ", "Second", None, "y", "3"),
         (3, "B2", None, "", None, "z", "1"), (4, "C3", None, "", "Upper Name", "w", ""),
         (5, "B2", None, "Named", None, "v", None)],
        "row_no long, `Kode Barang` string, kode_barang string, `Nama Produk` string, NAMA_PRODUK string, "
        "Tipe string, Garansi string")
    counts = CH.product_import_counts(sheet).first()
    assert (counts.imported, counts.skipped) == (4, 1)
    got = {r.kode_barang: (r.id, r.nama_produk, r.tipe, r.garansi_bulan)
           for r in CH.product_import(p, sheet, NOW).collect()}
    assert got == {"A1": (5, "Second", "y", 3), "C3": (6, "Upper Name", "w", 0), "B2": (7, "Named", "v", 0)}
    once = CH.product_import(p, sheet, NOW)
    twice = CH.product_import(once, sheet, NOW)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_sheet_warranty_parse(spark):
    sheet = spark.createDataFrame([(1, "K", "N", "12.5 bulan")], "row_no long, kode_barang string, "
                                  "nama_produk string, garansi string")
    assert CH.import_rows(sheet).first().garansi_bulan == 125


def test_ticket_numbers(spark):
    existing = S.rows(spark, S.TICKETS, [{"id": 1, "ticket_no": "SC-2024-000009"},
                                         {"id": 2, "ticket_no": "SC-2024-000003"}])   # last id, not max number
    req = spark.createDataFrame([(10, 2024), (11, 2024), (12, 2025)], "k long, year int")
    got = sorted((r.k, r.ticket_no) for r in CH.ticket_numbers(existing, req, ["k"]).collect())
    assert got == [(10, "SC-2024-000004"), (11, "SC-2024-000005"), (12, "SC-2025-000001")]


def js_parse(part):
    m = re.match(r"\s*[+]?(0[xX][0-9a-fA-F]+|[0-9]+)", part)
    return None if m is None else int(m[1], 16 if m[1][:2] in ("0x", "0X") else 10)


def test_numbers_continue_from_given_ones(spark):
    """A replay, request by request: given numbers, foreign ones, other years, unreadable ones, either case."""
    rnd = random.Random(4)
    made = ["SC-2024-000900", "sc-2024-7", "Sc-2024-  12x-9", "SC-2024-abc", "SC-2024-", "SC-2024-+5", "SC-2024-0x1F", "SC-2025-000040",
            "OTHER-1", "SC-02024-5", "SC-2024", "SC-2024-99999999999999999999"]
    rows = [(3 * i, rnd.choice([2024, 2024, 2025]), rnd.choice(made) if rnd.random() < 0.2 else rnd.choice([None, ""])) for i in range(900)]
    existing = S.rows(spark, S.TICKETS, [{"id": 1, "ticket_no": "SC-2024-000009"}, {"id": 2, "ticket_no": "SC-2024-000003"}])

    def replay(rows):
        last, out = {2024: "SC-2024-000003"}, {}
        for k, year, no in rows:
            if not no:
                base = js_parse(last[year].split("-")[2]) if year in last else 0
                no = f"SC-{year}-" + ("000NaN" if base is None else str(base + 1).zfill(6))
            m = re.match(r"(?i)SC-(2024|2025)-", no)
            if m:
                last[int(m[1])] = no
            out[k] = no
        return out

    req = spark.createDataFrame(rows, "k long, year int, ticket_no string").repartition(5)
    got = {r.k: r.ticket_no for r in CH.ticket_numbers(existing, req, ["k"]).collect()}
    assert got == replay(rows)
    one = [(k, no) for k, year, no in rows if year == 2024]
    want = replay([r for r in rows if r[1] == 2024])
    raw = spark.createDataFrame(one, "k long, ticket_no string").repartition(4)
    for c, ty in [("tanggal_complaint", "string"), ("tanggal_pembelian", "string"), ("product_id", "long"), ("created_by", "long")]:
        raw = raw.withColumn(c, F.lit(None).cast(ty))
    raw = raw.withColumn("customer_name", F.col("k").cast("string")).withColumn("keluhan", F.lit("x"))
    out = {int(r.customer_name): (r.id, r.ticket_no) for r in CH.ticket_intake(existing, raw, "2024-05-05 10:00:00", ["k"]).collect()}
    assert {k: no for k, (_, no) in out.items()} == want
    assert [out[k][0] for k, _ in one] == list(range(3, 3 + len(one)))


def test_sequence_numbers_match_row_number(spark):
    df = spark.range(0, 5000).selectExpr("id * 7 % 5003 AS k", "id % 3 AS g")
    got = CH.sequence_numbers(df, ["k"], partition=["g"], name="n", buckets=7)
    bad = got.selectExpr("n", "row_number() OVER (PARTITION BY g ORDER BY k) AS rn").where("n <> rn").count()
    assert bad == 0


def test_cascade_contains_semantics(spark):
    n = S.rows(spark, S.NOTIFICATIONS, [{"id": i, "link": link} for i, link in enumerate(
        ["/admin/tickets/1", "/admin/tickets/12", "/admin/tickets/2", "/teknisi/visit/1", "/ADMIN/tickets/10#x"])])
    ids = spark.createDataFrame([(1,)], "id long")
    tables = {"tickets": S.rows(spark, S.TICKETS, [{"id": 1}, {"id": 2}]), "notifications": n,
              "visit_results": S.rows(spark, S.VISIT_RESULTS, []), "activity_log": S.rows(spark, S.ACTIVITY_LOG, []),
              "schedules": S.rows(spark, S.SCHEDULES, [])}
    kept = sorted(r.link for r in CH.cascade_delete(tables, ids)["notifications"].collect())
    assert kept == ["/admin/tickets/2", "/teknisi/visit/1"]
    kept_exact = sorted(r.link for r in CH.cascade_delete(tables, ids, match="exact")["notifications"].collect())
    assert kept_exact == ["/ADMIN/tickets/10#x", "/admin/tickets/12", "/admin/tickets/2", "/teknisi/visit/1"]


def test_guarded_user_delete_keeps_last_admin(spark):
    u = S.rows(spark, S.USERS, [{"id": 1, "role": "admin"}, {"id": 2, "role": "admin"}, {"id": 3, "role": "cs"},
                                {"id": 4, "role": "guest"}])
    req = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 3), (5, 4), (6, 42), (7, 1), (8, 4)], "seq long, user_id long")
    got = {r.seq: (r.deleted, r.reason) for r in CH.guarded_user_delete(u, req).collect()}
    assert got == {1: (True, "deleted"), 2: (False, "cannot_delete_last_admin"), 3: (True, "deleted"),
                   4: (False, "user_not_found"), 5: (False, "invalid_role"), 6: (False, "user_not_found"),
                   7: (False, "cannot_delete_last_admin"), 8: (False, "invalid_role")}


def test_voucher_candidates(spark):
    t = S.rows(spark, S.TICKETS, [_ticket(id=1, approved_by=3), _ticket(id=2, approved_by=3), _ticket(id=3)])
    v = S.rows(spark, S.SERVICE_VOUCHERS, [{"id": 1, "ticket_id": 2}])
    p = S.rows(spark, S.PRODUCTS, [])
    got = CH.voucher_candidates(t, p, v, NOW, "s").collect()
    assert [(r.ticket_id, r.expired_at) for r in got] == [(1, "2024-05-31")]
    given = CH.voucher_candidates(t, p, v, NOW, "s", given_expiry="2030-01-01").first()
    assert given.expired_at == "2030-01-01"
    issued = CH.issue_vouchers(t, p, v, NOW, "s").first()
    assert issued.voucher_no.startswith("BRC-") and issued.id == 2 and len(issued.qr_token) == 64


def test_first_inserts_later_update(spark):
    """Repeated requests for a new key: author, time and id order of the first, values of the last."""
    r = spark.createDataFrame(
        [(1, 7, 5, "2024-05-01", "09:00", "a", 100, "t1"), (2, 8, 5, "2024-05-02", "10:00", "b", 101, "t2"),
         (3, 7, 6, "2024-05-03", " ", "c", 200, "t3"), (4, 9, 6, "2024-05-03", "", "c", 200, "t3")],
        "seq long, ticket_id long, teknisi_id long, tanggal string, jam string, notes string, user_id long, ts string")
    got = {x.ticket_id: x for x in CH.schedule_upsert(S.rows(spark, S.SCHEDULES, []), r).collect()}
    assert set(got) == {7, 8} and (got[7].id, got[8].id) == (1, 2)
    assert (got[7].created_by, got[7].created_at, got[7].teknisi_id, got[7].jam) == (100, "t1", 6, " ")
    v = spark.createDataFrame([(1, 7, 5, "f1", "s", "p", "", "09:00"), (2, 7, 6, " ", None, None, None, "10:00"), (3, 8, 5, "", "", "", "", "")],
                              "seq long, ticket_id long, teknisi_id long, findings string, solusi string, sparepart string, "
                              "tanggal_selesai string, jam string")
    rows = CH.visit_upsert(S.rows(spark, S.VISIT_RESULTS, []), v, NOW).collect()
    assert [(x.ticket_id, x.teknisi_id, x.hasil_pemeriksaan, x.jam) for x in rows] == [(7, 5, "", "10:00")]
    sheet = spark.createDataFrame([(1, "X2", "a"), (2, "X1", "b"), (3, "X2", "c")], "row_no long, kode_barang string, nama_produk string")
    p = {x.kode_barang: x for x in CH.product_import(S.rows(spark, S.PRODUCTS, []), sheet.withColumnRenamed("nama_produk", "Nama Produk"), NOW).collect()}
    assert (p["X2"].id, p["X1"].id, p["X2"].nama_produk) == (1, 2, "c") and p["X1"].created_at is not None


def test_keeps_last_photo_given(spark):
    r = spark.createDataFrame([(1, 7, 5, "f", "/p1"), (2, 7, 5, "g", None)], "seq long, ticket_id long, teknisi_id long, findings string, foto_sebelum_path string")
    r = r.selectExpr("*", "'' AS solusi", "'' AS sparepart", "'' AS tanggal_selesai", "'1' AS jam")
    visits = S.rows(spark, S.VISIT_RESULTS, [])
    got = CH.visit_upsert(visits, r, NOW).first()
    assert (got.foto_sebelum_path, got.hasil_pemeriksaan) == ("/p1", "g")


def test_voucher_numbers_do_not_repeat(spark):
    n = spark.range(1, 400_001).select(CH.voucher_number(F.col("id"), NOW).alias("v"))
    assert n.distinct().count() == 400_000


def test_unchanged_tickets_keep_a_null_counter(spark):
    t = S.rows(spark, S.TICKETS, [_ticket(id=1, follow_up_count=None)])
    ch = S.rows(spark, S.CHANGES, [])
    assert CH.apply_transitions(t, ch).first().follow_up_count is None


def test_constraint_report(spark):
    tables = {
        "users": S.rows(spark, S.USERS, [{"id": 1, "username": "a", "role": "admin"},
                                         {"id": 2, "username": "a", "role": "boss"}]),
        "notifications": S.rows(spark, S.NOTIFICATIONS, [{"id": 1, "message": None, "user_id": 1}]),
        "tickets": S.rows(spark, S.TICKETS, [{"id": 1, "ticket_no": "x", "status": "waiting", "created_by": 1}]),
        "schedules": S.rows(spark, S.SCHEDULES, [{"id": 1, "ticket_id": 5, "teknisi_id": 1}]),
    }
    got = {(r.table_name, r.rule): r.violations for r in Q.constraint_report(tables).collect()}
    assert got[("users", "unique:username")] == 2
    assert got[("users", "in_list:role")] == 1
    assert got[("notifications", "not_null:message")] == 1
    assert got[("schedules", "orphan:ticket_id->tickets")] == 1
    assert got[("tickets", "in_list:status")] == 0


def test_users_equal_a_replay(spark):
    """Few names, ids and admins, so that every outcome hangs on earlier ones."""
    from helpdeck.operators import users as U

    rnd = random.Random(6)
    roles = ["admin", "management", "teknisi", "cs"]
    for turn in range(2):
        users = [(i, f"n{i}", f"N{i}", roles[i % 4] if i < 6 else "odd", None, "e", 1, "t") for i in range(1, 8)]
        log = []
        for seq in range(0, 240, 2):
            log.append((seq, rnd.choice(["create", "edit", "edit", "delete", "other"]), rnd.choice([None, *range(1, 25)]), rnd.choice([None, "", *[f"n{k}" for k in range(1, 12)]]),
                        "p", rnd.choice([None, "", "X", "Y"]) if rnd.random() < 0.2 else f"X{seq}", rnd.choice(["admin", *roles, "odd", None] if turn else ["cs", "odd"]), rnd.choice([None, "1"]), None))
        now, top, want = {u[0]: list(u) for u in users}, 7, []
        for seq, kind, uid, username, _, name, role, phone, _ in log:
            holder = next((i for i, u in now.items() if u[1] == username), None)
            if kind == "create":
                if not (name and username and role):
                    why = "missing_fields"
                elif role not in roles:
                    why = "invalid_role"
                elif holder is not None:
                    why = "username_taken"
                else:
                    why, top = "user_created", top + 1
                    now[top] = [top, username, name, role, phone or "", "", 1, NOW]
                want.append((seq, kind, top if why == "user_created" else None, why))
            elif kind == "edit":
                if uid not in now or now[uid][3] not in roles:
                    why = "nothing_updated"
                elif name is None or username is None or role is None:
                    why = "missing_fields"
                elif holder is not None and holder != uid:
                    why = "username_taken"
                else:
                    why = "user_updated"
                    now[uid][1:6] = [username, name, role, phone or "", ""]
                want.append((seq, kind, -1 if uid is None else uid, why))
            elif kind == "delete":
                if uid not in now:
                    why = "user_not_found"
                elif now[uid][3] not in roles:
                    why = "invalid_role"
                elif now[uid][3] == "admin" and sum(u[3] == "admin" for u in now.values()) <= 1:
                    why = "cannot_delete_last_admin"
                else:
                    why = "user_deleted"
                    del now[uid]
                want.append((seq, kind, -1 if uid is None else uid, why))
        df = spark.createDataFrame(log, "seq long, kind string, user_id long, username string, password string, name string, role string, phone string, email string")
        table, verdicts = U.replay_users(S.rows(spark, S.USERS, [dict(zip(S.USERS.fieldNames(), u)) for u in users]), df.repartition(4), NOW)
        assert sorted((r.seq, r.kind, r.user_id, r.reason) for r in verdicts.collect()) == want
        assert sorted(map(list, table.collect())) == sorted(now.values())


def test_notification_links_are_built_before_the_join(spark):
    t = S.rows(spark, S.TICKETS, [_ticket(id=1, status="approval", ticket_no="SC-2024-000001", created_by=3)])
    ch = S.rows(spark, S.CHANGES, [{"seq": 1, "ticket_id": 1, "kind": "reject", "ts": "x", "user_id": 9, "decision": "reject", "text": "n"}])
    users = S.rows(spark, S.USERS, [{"id": 1, "role": "cs"}, {"id": 2, "role": "admin"}])
    df = CH.emit_notifications(t, ch, users, S.rows(spark, S.SCHEDULES, []))
    assert "concat" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert sorted((r.user_id, r.link) for r in df.collect()) == [(1, "/admin/tickets/1"), (2, "/admin/tickets/1")]


def test_a_round_of_the_user_log_runs_each_scan_once(spark):
    from helpdeck.operators import users as U
    from helpdeck.operators.pieces import cut

    users = S.rows(spark, S.USERS, [{"id": 1, "username": "a", "role": "admin"}, {"id": 2, "username": "b", "role": "cs"}])
    log = spark.createDataFrame([(i, "delete", i % 3, None, None, None) for i in range(9)],
                                "seq long, kind string, user_id long, username string, role string, _bad string")
    steps = cut(log, ["seq"]).withColumn("done", F.col("_bad").isNull())
    d = U._round(steps, users.select("id", "username", "role"), 2, 1)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2  # the last scan's alone: the earlier ones' results are read
    assert [r.reason for r in d.orderBy("seq").collect()][:3] == ["user_not_found", "cannot_delete_last_admin", "user_deleted"]
