"""Per-ticket progress timeline, next-action flags and follow-up candidates
(SURVEY 2.5 E8, 2.2 B17-B18).

The first schedule/visit per ticket is a ``min_by`` partial aggregate, so
the join back to tickets is one row per ticket on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.functions.labels import followup_message, needs_followup
from helpdeck.operators.enrich import first_per_key

# ---- fixed values (must equal the reference) -------------------------------
STEP_LABELS = ["Complaint Masuk", "Approval Management", "Jadwal Teknisi", "Kunjungan", "Selesai / Closed"]
# -----------------------------------------------------------------------------


def _with_first_children(tickets: DataFrame, schedules: DataFrame, visits: DataFrame) -> DataFrame:
    s = first_per_key(schedules, "ticket_id", "id",
                      [F.col("id").alias("schedule_id"), F.col("tanggal").alias("s_tanggal"),
                       F.col("jam").alias("s_jam")]).withColumnRenamed("ticket_id", "_st")
    v = first_per_key(visits, "ticket_id", "id",
                      [F.col("id").alias("visit_id"), F.col("tanggal").alias("v_tanggal"),
                       F.col("jam").alias("v_jam"), F.col("solusi").alias("v_solusi")]
                      ).withColumnRenamed("ticket_id", "_vt")
    t = tickets.join(s, tickets["id"] == s["_st"], "left").drop("_st")
    return t.join(v, t["id"] == v["_vt"], "left").drop("_vt")


def _truthy(c) -> F.Column:
    return c.isNotNull() & (c.cast("string") != "")


def ticket_progress(tickets: DataFrame, schedules: DataFrame, visits: DataFrame, by: str = "status") -> DataFrame:
    """E8 five-step timeline per ticket, one row per step (ticket_id, step, label, done, date).

    ``by='status'`` is the screen variant (approval done when status is not
    'waiting', closed when completed/rejected); ``by='timestamps'`` is the
    print variant (done when approved_at / closed_at is set, '-' for missing dates).
    """
    t = _with_first_children(tickets, schedules, visits)
    sched_date = F.concat(F.col("s_tanggal"), F.lit(" "), F.col("s_jam"))
    visit_date = F.concat(F.col("v_tanggal"), F.lit(" "), F.col("v_jam"))
    has_s, has_v = F.col("schedule_id").isNotNull(), F.col("visit_id").isNotNull()
    st = F.col("status")
    if by == "status":
        done = [F.lit(True), F.coalesce(st != "waiting", F.lit(True)), has_s, has_v,
                F.coalesce(st.isin("completed", "rejected"), F.lit(False))]
        dates = [F.col("created_at"), F.col("approved_at"), sched_date, visit_date, F.col("closed_at")]
    else:
        dash = F.lit("-")
        done = [F.lit(True), _truthy(F.col("approved_at")), has_s, has_v, _truthy(F.col("closed_at"))]
        dates = [F.col("created_at"), F.coalesce(F.nullif("approved_at", F.lit("")), dash),
                 F.when(has_s, sched_date).otherwise(dash), F.when(has_v, visit_date).otherwise(dash),
                 F.coalesce(F.nullif("closed_at", F.lit("")), dash)]
    steps = F.array(*[F.struct(F.lit(lbl).alias("label"), d.alias("done"), dt.alias("date"))
                      for lbl, d, dt in zip(STEP_LABELS, done, dates)])
    return (t.select(F.col("id").alias("ticket_id"), F.posexplode(steps).alias("pos", "s"))
            .select("ticket_id", (F.col("pos") + 1).alias("step"), "s.label", "s.done", "s.date"))


def ticket_next_action(tickets: DataFrame, schedules: DataFrame, visits: DataFrame) -> DataFrame:
    """B18 next-action flags per ticket (not exclusive)."""
    t = _with_first_children(tickets, schedules, visits)
    st = F.col("status")
    return t.select(
        "id", "ticket_no", "status",
        F.coalesce((st == "waiting") & ~_truthy(F.col("admin_analysis")), F.lit(False)).alias("needs_analysis"),
        F.coalesce(st == "approval", F.lit(False)).alias("awaiting_approval"),
        F.coalesce((st == "waiting") & _truthy(F.col("admin_analysis"))
                   & F.coalesce(F.col("approved_by") != 0, F.lit(False)),
                   F.lit(False)).alias("schedulable"),
        F.coalesce((st == "scheduled") & F.col("schedule_id").isNotNull(), F.lit(False)).alias("scheduled"),
        F.coalesce((st == "on_progress") & needs_followup(F.col("v_solusi")), F.lit(False)).alias("needs_followup"),
        F.coalesce(st == "on_progress", F.lit(False)).alias("closable"),
        F.coalesce(_truthy(F.col("management_decision")) & (F.col("management_decision") != "reject"),
                   F.lit(False)).alias("voucher_eligible"))


def followup_candidates(visits: DataFrame) -> DataFrame:
    """B17 visits whose outcome asks for an admin follow-up, with the activity text."""
    return (visits.filter(needs_followup(F.col("solusi")))
            .select(F.col("id").alias("visit_id"), "ticket_id", "teknisi_id", "solusi",
                    followup_message(F.col("solusi")).alias("message")))
