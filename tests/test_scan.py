"""Distributed sequential scans equal a plain sequential pass, hot keys included."""

import datetime as dt
import random

from pyspark.sql import functions as F

from helpdeck.operators import delivery as D
from helpdeck.operators.scan import prefix_scan
from helpdeck.operators.sequence import hour_bucket, reset_scan


def test_prefix_scan_matches_sequential_fold(spark):
    rnd = random.Random(3)
    rows, seq = [], 0
    for k in range(4):
        for _ in range(4200 if k == 0 else rnd.randint(1, 90)):   # key 0: hot, spans several tree levels
            seq += rnd.randint(1, 4)
            rows.append((k, seq, [rnd.randrange(3) for _ in range(3)], rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "k long, s long, t array<int>, inc int")
    got = {(r.k, r.s): (list(r.prefix), r.inc_before) for r in prefix_scan(df, "k", "s", "t", "inc", 3).collect()}
    state = {}
    for k, s, t, inc in rows:
        cur, c = state.get(k, ([0, 1, 2], 0))
        assert got[(k, s)] == (cur, c)
        state[k] = ([t[x] for x in cur], c + inc)


def test_reset_scan_matches_sequential(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        addr = 0 if i % 3 else rnd.randint(1, 5)                 # address 0 holds two thirds of the rows
        rows.append((i, base + dt.timedelta(seconds=37 * i), addr, int(rnd.random() < 0.2)))
    df = spark.createDataFrame(rows, "id long, ts timestamp, address long, ok int")
    out = reset_scan(df, ["address"], ["ts", "id"], F.col("ok") == 1, hour_bucket(F.col("ts"), 600))
    got = {r.id: (r.before, r.resets_before) for r in out.collect()}
    state = {}
    for i, _, a, ok in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        before, resets = state.get(a, (0, 0))
        assert got[i] == (before, resets)
        state[a] = (0, resets + 1) if ok else (before + 1, resets)


def test_delivery_interleaved_messages(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 0, 0)
    steps = [("0812", "a", 0), ("0812", "b", 0), ("+62 812", "a", 1),      # a delivered on its 2nd try, b in between
             ("0812", "b", 0), ("0812", "b", 0), ("x1", "a", 0), ("0813", "a", 1)]
    rows = [(i, t0 + dt.timedelta(minutes=40 * i), *s) for i, s in enumerate(steps)]
    a = spark.createDataFrame(rows, "id long, ts timestamp, address string, message string, ok int")
    out = D.delivery_outcome(a)
    assert sorted((r.address, r.message, r.attempts, r.delivered) for r in out.collect()) == [
        ("62812", "a", 2, True), ("62812", "b", 3, False), ("62813", "a", 1, True), ("x1", "a", 1, False)]
    s = D.delivery_summary(out).first()
    assert (s.ok, s.failed, s.total) == (2, 2, 4)
    # every failed try of b has an entry; the number that is no phone has none
    assert [(r.id, r.address, r.message) for r in D.dead_letter(a).collect()] == [
        (4, "62812", "b"), (3, "62812", "b"), (1, "62812", "b")]


def test_dead_letter_matches_sequential_list(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * (i // 2)), "08%d" % (0 if i % 3 else rnd.randint(1, 3)),
             "m%d" % rnd.randint(0, 1), int(rnd.random() < 0.5)) for i in range(2000)]
    a = spark.createDataFrame(rows, "id long, ts timestamp, address string, message string, ok int")
    listed = []
    for i, _, phone, message, ok in rows:
        if not ok:
            listed.insert(0, (i, phone, message))
        else:
            hit = next((x for x in listed if x[1:] == (phone, message)), None)
            if hit:
                listed.remove(hit)
    assert [r.id for r in D.dead_letter(a, k=5000).collect()] == [x[0] for x in listed]
    assert sorted(r.id for r in D.failed_entries(a).collect()) == sorted(x[0] for x in listed)


def test_burst_failures_reset_and_saturation(spark):
    t0 = dt.datetime(2024, 1, 1, 9, 0, 0)
    rows, i = [], 0
    for s in range(0, 9 * 30, 30):          # 9 failures
        rows.append((i, t0 + dt.timedelta(seconds=s), 1, 0)); i += 1
    rows.append((i, t0 + dt.timedelta(seconds=280), 1, 1)); i += 1     # a success clears the count
    for s in range(300, 300 + 12 * 30, 30):  # 12 failures in the same 15-minute period
        rows.append((i, t0 + dt.timedelta(seconds=s), 1, 0)); i += 1
    for s in range(0, 9 * 30, 30):          # address 2: 9 failures only
        rows.append((i, t0 + dt.timedelta(seconds=s), 2, 0)); i += 1
    a = spark.createDataFrame(rows, "id long, ts timestamp, address long, ok int")
    got = [(r.address, r.period_start, r.n, r.tenth_at) for r in D.burst_failures(a).collect()]
    assert got == [(1, "2024-01-01 09:00:00", 10, "2024-01-01 09:09:30")]
    simple = sorted((r.address, r.failures) for r in D.burst_failures_simple(a).collect())
    assert simple == [(1, 21)]


def _deliveries(spark, log):
    """``log``: (message, ok) in order; two attempts share each second."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i // 2), "08123456789" if m % 2 else "+62 812-3456-789", f"m{m}", ok) for i, (m, ok) in enumerate(log)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, address string, message string, ok int").repartition(5)


def _replayed(log, k):
    entries = []
    for i, (m, ok) in enumerate(log):
        if not ok:
            entries = [(i, m), *entries][:k]
        else:
            at = next((j for j, e in enumerate(entries) if e[1] == m), None)
            if at is not None:
                del entries[at]
    return [i for i, _ in entries]


def test_failed_list_is_replayed_with_its_cap(spark):
    rnd = random.Random(9)
    logs = [([(0, 0)] * 52 + [(0, 1), (0, 1)], 50),                      # entries 2 and 1 were dropped before the successes
            ([(i, 0) for i in range(60)] + [(59, 1), (3, 1)], 50),        # a success for a dropped entry takes nothing away
            ([(0, 1)] * 3, 50), ([], 50)]
    for share in (0.3, 0.5, 0.6):
        # message 0 holds a third of the log
        logs.append(([(rnd.choice([0, 0, 0, *range(1, 7)]), int(rnd.random() < share)) for _ in range(3000)], 7))
    for log, k in logs:
        got = [r.id for r in D.dead_letter(_deliveries(spark, log), k).collect()]
        assert got == _replayed(log, k)


def test_transitions_equal_a_replay(spark):
    """Statuses, counters and the schedule that a cancellation meets, for a hot ticket and an unknown one."""
    from helpdeck import schemas as S
    from helpdeck.operators import changes as CH

    rnd = random.Random(12)
    statuses = ["waiting", "approval", "rejected", "scheduled", "on_progress", "completed", None]
    tickets = [{"id": i, "status": statuses[i % 7], "follow_up_count": i % 3} for i in range(20)]
    rows = []
    for seq in range(2500):
        kind = rnd.choice(["reset", "calendar_schedule", "reset", "calendar_schedule", *CH.TRANSITION_KINDS, "other"])
        rows.append({"seq": seq, "ticket_id": rnd.choice([0, 0, 99, rnd.randrange(20), None]), "kind": kind, "ts": str(seq), "user_id": 1, "text": "x",
                     "decision": rnd.choice(["Servis", "Nein"]), "teknisi_id": rnd.choice([None, 5, 6, 7]), "tanggal": rnd.choice(["", "2024-01-01"]),
                     "jam": "10:00", "findings": rnd.choice(["", "f"]), "solusi": rnd.choice(["Servis", "Butuh Sparepart (Follow-up)"])})
    t, ch = S.rows(spark, S.TICKETS, tickets), S.rows(spark, S.CHANGES, rows).repartition(6)
    got = {r.seq: r for r in CH.scan_changes(t, ch).collect()}
    now = {x["id"]: [x["status"], x["follow_up_count"]] for x in tickets}
    plan = {}
    for r in rows:
        if r["ticket_id"] is None:
            assert r["seq"] not in got
            continue
        g, kind, i = got[r["seq"]], r["kind"], r["ticket_id"]
        status, count = now.get(i, [None, None])
        valid = {"schedule": r["teknisi_id"] is not None and r["tanggal"] != "", "calendar_schedule": r["teknisi_id"] is not None and r["tanggal"] != "",
                 "approve": r["decision"] == "Servis", "visit_result": r["findings"] != ""}.get(kind, kind in CH.TRANSITION_KINDS)
        ok = valid and {"reset": status in ("waiting", "rejected"), "calendar_schedule": status in ("waiting", "approval")}.get(kind, True)
        assert (g.valid, g.applies) == (valid, ok and i in now), r
        if i in now:
            assert (g.status_before, g.count_before) == (status, count), r
            if ok:
                now[i][0] = {"analysis": "approval", "followup": "approval", "schedule": "scheduled", "calendar_schedule": "scheduled",
                             "cancel_schedule": "waiting", "approve": "waiting", "reject": "rejected", "reset": "approval",
                             "start_visit": "on_progress", "visit_result": "on_progress", "close": "completed"}[kind]
            if valid and (kind == "followup" or kind == "visit_result" and r["solusi"] != "Servis"):
                now[i][1] += 1
            assert g.status_after == now[i][0], r
        before = plan.get(i, "none yet")
        assert ("none yet" if g.schedule_before is None else g.schedule_before.teknisi_id) == before, r
        if valid and kind in ("schedule", "calendar_schedule", "cancel_schedule"):
            plan[i] = None if kind == "cancel_schedule" else r["teknisi_id"]


def test_running_totals_match_a_sequential_pass(spark):
    from helpdeck.operators.pieces import cut, running

    rnd = random.Random(2)
    rows = [(rnd.randrange(3) if i % 3 else 0, i // 2, i, rnd.choice([None, i]), rnd.randrange(-2, 3)) for i in range(4000)]
    d = cut(spark.createDataFrame(rows, "k int, t long, id long, v long, w int").repartition(7), ["t", "id"])
    assert d.select("_p").distinct().count() > 4
    totals = {"s": ("sum", F.col("w")), "m": ("max", F.col("w")), "l": ("last", F.col("v")), "n": ("min", F.col("v"))}
    for keys in (["k"], []):
        got = {r.id: (r.s, r.m, r.l, r.n) for r in running(d, keys, ["t", "id"], totals).collect()}
        state = {}
        for k, _, i, v, w in rows:
            k = k if keys else 0
            s, m, last, n = state.get(k, (0, None, None, None))
            assert got[i] == (s, m, last, n)
            state[k] = (s + w, w if m is None else max(m, w), last if v is None else v, n if v is None else v if n is None else min(n, v))
