"""Change application: old table + batch of changes -> new table.

Parquet has no row update, so each operator is a pure function returning the
whole new table (or the rows it adds); the caller writes it to a new path
and publishes it (``helpdeck.sources.io.publish``), never overwriting the
path being read.

Ordering inside a batch is explicit: every change carries a ``seq`` (a log
sequence number) and later changes win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helpdeck.functions.dates import TS_FMT, default_expiry, now_ts
from helpdeck.functions.labels import STATUSES, needs_followup
from helpdeck.functions.text import digits_int, first_truthy, js_trim, parse_int, trim_str, zero_pad
from helpdeck.operators.pieces import cut, running

# ---- fixed values (must equal the reference) -------------------------------
TRANSITION_KINDS = ["analysis", "followup", "schedule", "calendar_schedule", "cancel_schedule",
                    "approve", "reject", "reset", "start_visit", "visit_result", "close"]
APPROVE_DECISIONS = ["Servis", "Ganti Unit"]
DEFAULT_FOLLOWUP_NOTE = "Follow-up diperlukan (kunjungan sebelumnya belum selesai)"
ACTIVITY_TEXTS = {
    "analysis": ("send_approval", "Dikirim ke management untuk approval"),
    "schedule": ("schedule", "Dijadwalkan ke teknisi pada {tanggal} {jam}"),
    "calendar_schedule": ("schedule", "Dijadwalkan: {tanggal} {jam} - {teknisi_id}"),
    "cancel_schedule": ("schedule", "Jadwal dibatalkan"),
    "reset": ("reset_approval", "Approval direset, perlu persetujuan ulang"),
    "start_visit": ("start_visit", "Kunjungan dimulai"),
    "close": ("close", "Ticket ditutup"),
}
INTAKE_LIMITS = {"kode_barang": 50, "customer_name": 100, "customer_alamat": 200, "customer_hp": 20,
                 "customer_email": 100, "customer_kota": 100, "customer_provinsi": 100, "toko": 100,
                 "marketplace": 100, "nomor_invoice": 50, "serial_number": 100, "keluhan": 1000}
INTAKE_PATHS = ["faktur_path", "foto_produk_path", "video_path", "foto_kerusakan_path"]
CREATED_TEXT = ("create", "Ticket dibuat")
VOUCHER_ISSUED_TEXT = "Voucher {voucher_no} sudah diterbitkan untuk {customer_name}"
VOUCHER_SENT_TEXT = ("voucher_wa", "Voucher dikirim ke WA {customer_hp}")
RESET_COMMENT = "Approval direset oleh Management"
NO_COMMENT = "Tidak ada komentar"
# -----------------------------------------------------------------------------

# status index 0..5 as in STATUSES, 6 = anything else (NULL included)
N_STATES = len(STATUSES) + 1
_IDX = {s: i for i, s in enumerate(STATUSES)}


def status_index(c: Column) -> Column:
    m = F.create_map(*[x for s, i in _IDX.items() for x in (F.lit(s), F.lit(i))])
    return F.coalesce(m[c], F.lit(N_STATES - 1))


def _status_name(idx: Column, fallback: Column) -> Column:
    names = F.array(*[F.lit(s) for s in STATUSES])
    return F.when(idx < len(STATUSES), F.element_at(names, idx + 1)).otherwise(fallback)


_RESET_FROM = ("waiting", "rejected")
_CAL_FROM = ("waiting", "approval")


def given(c: str) -> Column:
    """A form value that is there: not NULL and not '' (white space counts, it is trimmed only when stored)."""
    return F.coalesce(F.col(c).cast("string") != "", F.lit(False))


def change_validity(kind: Column) -> Column:
    """Event-level checks on the raw values, made before the ticket is touched."""
    return (F.when(kind.isin("schedule", "calendar_schedule"), given("teknisi_id") & given("tanggal") & given("jam"))
            .when(kind == "approve", F.coalesce(F.col("decision").isin(*APPROVE_DECISIONS), F.lit(False)))
            .when(kind == "visit_result", given("findings"))
            .otherwise(kind.isin(*TRANSITION_KINDS)))


_SETS = {"analysis": "approval", "followup": "approval", "schedule": "scheduled", "cancel_schedule": "waiting", "approve": "waiting",
         "reject": "rejected", "start_visit": "on_progress", "visit_result": "on_progress", "close": "completed"}
_SCHEDULES = ("schedule", "calendar_schedule", "cancel_schedule")


def _status_between(start: Column, resets: Column, calendars: Column, reset_before_calendar: Column) -> Column:
    """Status index after the guarded changes that follow a status ``start``.

    Only two kinds look at the status. A calendar schedule takes waiting and approval to scheduled, where
    neither kind does anything any more; a reset takes waiting and rejected to approval. So what happened is
    told by whether there was a reset, a calendar schedule, and, from rejected, a reset before the latest of these.
    """
    i = {s: F.lit(_IDX[s]) for s in STATUSES}
    opened = F.when(resets > 0, i["approval"]).otherwise(start)
    return (F.when(start == i["waiting"], F.when(calendars > 0, i["scheduled"]).otherwise(opened))
            .when(start == i["approval"], F.when(calendars > 0, i["scheduled"]).otherwise(start))
            .when(start == i["rejected"], F.when((calendars > 0) & reset_before_calendar, i["scheduled"]).otherwise(opened))
            .otherwise(start))


def scan_changes(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """Per change: ``valid``, ``status_before``/``status_after`` (by replaying
    every earlier change of the same ticket), ``applies`` (the ticket row is
    updated), ``writes`` (the change leaves log and notification rows),
    ``count_before`` (follow-up counter before the change), ``schedule_before`` (what the latest earlier schedule
    request or cancellation of the ticket left: struct ``teknisi_id``, NULL in it after a cancellation; NULL where none came before).

    ``changes``: seq, ticket_id, kind, ts (text), user_id, text, decision,
    teknisi_id, tanggal, jam, findings, solusi; ``seq`` is unique within a
    ticket. Changes of unknown tickets stay: they update nothing, but only
    follow-up and reset look for the ticket first, the others still write
    their rows. A change without a ticket id is none.

    The log is cut into pieces by ``seq`` and scanned twice (``pieces.running``): counters first, then what the latest
    change of a sort left and where the counters stood there. Both scans and the joins between share one shuffle by
    (ticket, piece), so a ticket with a third of the log is as many tasks as there are pieces. To write several outputs of one
    batch, write this result once and hand it to them.
    """
    base = tickets.select(F.col("id").alias("_tid"), F.col("status").alias("_base_status"),
                          F.coalesce(F.col("follow_up_count"), F.lit(0)).cast("long").alias("_base_count"), F.lit(True).alias("_known"))
    kind = F.col("kind")
    ch = changes.filter(F.col("ticket_id").isNotNull()).withColumn("valid", change_validity(kind))
    inc = F.col("valid") & ((kind == "followup") | ((kind == "visit_result") & needs_followup(F.col("solusi"))))
    one = lambda c: F.when(c, 1).otherwise(0)
    ch = running(cut(ch, ["seq"]), ["ticket_id"], ["seq"], {
        "_r": ("sum", one(F.col("valid") & (kind == "reset"))), "_c": ("sum", one(F.col("valid") & (kind == "calendar_schedule"))),
        "_inc": ("sum", one(inc))})
    sets = F.create_map(*[x for k, v in _SETS.items() for x in (F.lit(k), F.lit(_IDX[v]))])[kind]
    ch = ch.withColumn("_to", F.when(F.col("valid"), sets))
    ch = running(ch, ["ticket_id"], ["seq"], {
        "_set": ("last", F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("i"), F.col("_r").alias("r"), F.col("_c").alias("c")))),
        "_cal": ("last", F.when(F.col("valid") & (kind == "calendar_schedule"), F.struct(F.col("_r").alias("r")))),
        "schedule_before": ("last", F.when(F.col("valid") & kind.isin(*_SCHEDULES), F.struct(
            F.when(kind != "cancel_schedule", F.col("teknisi_id")).alias("teknisi_id"))))})
    s = ch.join(base, ch["ticket_id"] == base["_tid"], "left")
    r0, c0 = F.coalesce("_set.r", F.lit(0)), F.coalesce("_set.c", F.lit(0))
    before = _status_between(F.coalesce("_set.i", status_index(F.col("_base_status"))), F.col("_r") - r0, F.col("_c") - c0,
                             F.col("_cal.r") > r0)
    s = s.withColumn("_bi", before)
    opens = F.col("valid") & (kind == "reset") & F.col("_bi").isin(*[_IDX[x] for x in _RESET_FROM])
    plans = F.col("valid") & (kind == "calendar_schedule") & F.col("_bi").isin(*[_IDX[x] for x in _CAL_FROM])
    after = F.when(opens, _IDX["approval"]).when(plans, _IDX["scheduled"]).otherwise(F.coalesce("_to", "_bi"))
    guard_ok = F.when(kind == "reset", opens).when(kind == "calendar_schedule", plans).otherwise(F.lit(True))
    known = F.col("_known").isNotNull()
    return (s.withColumn("status_before", _status_name(F.col("_bi"), F.col("_base_status")))
             .withColumn("status_after", _status_name(after, F.col("_base_status")))
             .withColumn("applies", F.col("valid") & guard_ok & known)
             # a calendar schedule is logged even when its status guard refuses the status change
             .withColumn("writes", F.col("applies") | (F.col("valid") & (
                 (kind == "calendar_schedule") | (~known & ~kind.isin("followup", "reset")))))
             .withColumn("count_before", F.col("_base_count") + F.col("_inc"))
             .select(*changes.columns, "valid", "status_before", "status_after", "applies", "writes", "count_before", "schedule_before"))


def _followup_line(count_before: Column, note: Column) -> Column:
    n = (count_before + 1).cast("string")
    return F.concat(F.lit("\n[Follow-up #"), n, F.lit("] "),
                    F.coalesce(F.nullif(note, F.lit("")), F.lit(DEFAULT_FOLLOWUP_NOTE)))


def _last(cond: Column, value: Column, name: str) -> Column:
    """Value of the highest-seq row where ``cond`` holds (struct keeps NULL values)."""
    return F.max_by(F.when(cond, F.struct(value.alias("v"))), F.when(cond, F.col("seq"))).alias(name)


def apply_transitions(tickets: DataFrame, changes: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """I1 status transitions with guards, several ordered changes per ticket (``scanned``: see ``scan_changes``).

    Returns the whole tickets table; tickets without changes are unchanged.
    Every per-ticket result is a commutative aggregate (``max_by`` on seq,
    sums) over scanned changes, so partial aggregation absorbs hot tickets.
    """
    s = scan_changes(tickets, changes) if scanned is None else scanned
    a = F.col("applies")
    kind = F.col("kind")
    dec_kinds = kind.isin("approve", "reject", "reset")
    agg = s.groupBy("ticket_id").agg(
        F.max_by("status_after", "seq").alias("_status"),
        _last(a & (kind == "analysis"), F.col("text"), "_an"),
        F.max(F.when(a & (kind == "analysis"), F.col("seq"))).alias("_an_seq"),
        F.collect_list(F.when(a & (kind == "followup"), F.struct(
            "seq", _followup_line(F.col("count_before"), F.col("text")).alias("line")))).alias("_lines"),
        _last(a & dec_kinds, F.when(kind == "reset", F.lit(None).cast("string"))
              .when(kind == "reject", F.lit("reject")).otherwise(F.col("decision")), "_dec"),
        _last(a & dec_kinds, F.when(kind == "reset", F.lit(None).cast("string"))
              .otherwise(F.coalesce(F.col("text"), F.lit(""))), "_com"),
        _last(a & kind.isin("approve", "reset"), F.when(kind == "approve", F.col("user_id")), "_apb"),
        _last(a & kind.isin("approve", "reset"), F.when(kind == "approve", F.col("ts")), "_apa"),
        _last(a & (kind == "close"), F.col("user_id"), "_clb"),
        _last(a & (kind == "close"), F.col("ts"), "_cla"),
        _last(a, F.col("ts"), "_upd"),
        F.sum(F.when(a & ((kind == "followup") | ((kind == "visit_result") & needs_followup(F.col("solusi")))), 1)
              .otherwise(0)).alias("_inc"))
    # analysis text: last explicit analysis, then the follow-up lines after it, in order
    later = F.filter("_lines", lambda x: F.col("_an_seq").isNull() | (x["seq"] > F.col("_an_seq")))
    upd = (agg.withColumn("_fu_text", F.array_join(F.transform(F.array_sort(later), lambda x: x["line"]), ""))
           .drop("_lines", "_an_seq").withColumnRenamed("ticket_id", "_tid"))
    t = tickets.join(upd, tickets["id"] == upd["_tid"], "left")
    has = F.col("_tid").isNotNull()

    def pick(struct_col: str, old: str) -> Column:
        return F.when(F.col(struct_col).isNotNull(), F.col(f"{struct_col}.v")).otherwise(F.col(old))

    an_base = F.when(F.col("_an").isNotNull(), F.col("_an.v")).otherwise(F.col("admin_analysis"))
    analysis = F.when(F.col("_fu_text") != "", F.concat(F.coalesce(an_base, F.lit("")), F.col("_fu_text"))) \
        .otherwise(an_base)
    new = {
        "status": F.when(has, F.col("_status")).otherwise(F.col("status")),
        "admin_analysis": analysis,
        "management_decision": pick("_dec", "management_decision"),
        "management_comment": pick("_com", "management_comment"),
        "approved_by": pick("_apb", "approved_by"),
        "approved_at": pick("_apa", "approved_at"),
        "closed_by": pick("_clb", "closed_by"),
        "closed_at": pick("_cla", "closed_at"),
        "follow_up_count": F.when(has, F.coalesce(F.col("follow_up_count"), F.lit(0)) + F.coalesce(F.col("_inc"), F.lit(0)))
        .otherwise(F.col("follow_up_count")).cast("int"),
        "updated_at": pick("_upd", "updated_at"),
    }
    cols = [new[c].cast(dict(tickets.dtypes)[c]).alias(c) if c in new else F.col(c) for c in tickets.columns]
    return t.select(*cols)


def followup_apply(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """E3 follow-up counter +1 per follow-up change, note lines appended, for
    the tickets that received follow-ups (id, status, follow_up_count,
    admin_analysis, updated_at). Follow-ups have no status guard, so a
    follow-up's number is its place among those of its ticket: no scan."""
    fu = (changes.filter(F.col("kind") == "followup").groupBy(F.col("ticket_id").alias("id"))
          .agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_fu"), F.max_by("ts", "seq").alias("_ts")))
    base = F.coalesce(F.col("follow_up_count"), F.lit(0))
    lines = F.transform("_fu", lambda x, i: _followup_line(F.col("_base") + i, x["text"]))
    return tickets.join(fu, "id").withColumn("_base", base).select(
        "id", F.lit("approval").alias("status"), (F.col("_base") + F.size("_fu")).cast("int").alias("follow_up_count"),
        F.concat(F.coalesce(F.col("admin_analysis"), F.lit("")), F.array_join(lines, "")).alias("admin_analysis"),
        F.col("_ts").alias("updated_at"))


def _fill(tpl: str) -> Column:
    """Template with ``{column}`` placeholders -> concat expression."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", tpl):
        parts.append(F.lit(tpl[pos:m.start()]))
        parts.append(F.col(m.group(1)).cast("string"))
        pos = m.end()
    parts.append(F.lit(tpl[pos:]))
    return F.concat(*parts)


def emit_events(tickets: DataFrame, changes: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """I12 rows each accepted change writes: one activity row per change and,
    for approve/reject/reset, one approval-log row (``old_status`` is written
    as 'approval' for approve/reject, as the reference does); changes of unknown
    tickets included, see ``scan_changes``."""
    from helpdeck.functions.labels import followup_message

    s = scan_changes(tickets, changes) if scanned is None else scanned
    kind = F.col("kind")
    s = s.filter(F.col("writes"))
    txt = F.coalesce(F.col("text"), F.lit(""))
    n = (F.col("count_before") + 1).cast("string")
    fu_visit = needs_followup(F.col("solusi"))
    action = (F.when(kind == "followup", F.lit("send_approval"))
              .when(kind == "approve", F.lit("approve"))
              .when(kind == "reject", F.lit("reject"))
              .when(kind == "visit_result", F.when(fu_visit, F.lit("follow_up")).otherwise(F.lit("visit"))))
    desc = (F.when(kind == "followup", F.concat(F.lit("Follow-up #"), n,
                                                 F.lit(" dikirim ke management untuk re-approval")))
            .when(kind == "approve", F.concat(F.lit("Disetujui: "), F.col("decision"), F.lit(" - "), txt))
            .when(kind == "reject", F.concat(F.lit("Ditolak: "),
                                             F.coalesce(F.nullif(txt, F.lit("")), F.lit(NO_COMMENT))))
            .when(kind == "visit_result", F.when(fu_visit, followup_message(F.col("solusi")))
                  .otherwise(F.lit("Kunjungan dilakukan"))))
    for k, (act, tpl) in ACTIVITY_TEXTS.items():
        action = F.when(kind == k, F.lit(act)).otherwise(action)
        desc = F.when(kind == k, _fill(tpl)).otherwise(desc)
    activity = s.select(
        F.lit("activity_log").alias("target"), "seq", "ticket_id", "user_id", action.alias("action"),
        desc.alias("description"), F.lit(None).cast("string").alias("decision"),
        F.lit(None).cast("string").alias("old_status"), F.lit(None).cast("string").alias("new_status"))
    alog = s.filter(kind.isin("approve", "reject", "reset")).select(
        F.lit("approval_logs").alias("target"), "seq", "ticket_id", "user_id", kind.alias("action"),
        F.when(kind == "reset", F.lit(RESET_COMMENT)).otherwise(txt).alias("description"),
        F.when(kind == "reset", F.lit("")).when(kind == "reject", F.lit("reject"))
         .otherwise(F.col("decision")).alias("decision"),
        F.when(kind == "reset", F.col("status_before")).otherwise(F.lit("approval")).alias("old_status"),
        F.when(kind == "approve", F.lit("waiting")).when(kind == "reject", F.lit("rejected"))
         .otherwise(F.lit("approval")).alias("new_status"))
    return activity.unionByName(alog)


def last_per_key(df: DataFrame, key, order: str) -> DataFrame:
    """The row with the highest ``order`` per key (E6 "last row wins").

    ``max_by`` is a partial aggregate: each map task keeps one candidate per
    key, so a key written by a third of the batch still moves one row per
    task. ``order`` must be unique within a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))


# ----------------------------------------------------------------- numbering
def sequence_numbers(df: DataFrame, order: list, partition: list | None = None, name: str = "rn",
                     buckets: int | None = None) -> DataFrame:
    """Dense 1-based numbers in ``order`` (within ``partition``), without a
    single-partition window: rows are range-partitioned on the order key,
    each range is numbered locally and shifted by the sizes of the ranges
    before it (a tiny per-range count table). Equal to
    ``row_number() over (partition by .. order by ..)``; ``order`` must be
    unique within a partition.

    The locally numbered rows are checkpointed (reliable checkpoint in the
    shared ``spark.checkpoint.dir``) before the range sizes are counted: the
    partition ids must be the *same* in both uses, and adaptive execution may
    otherwise coalesce the two reads of the range shuffle differently. The
    checkpoint also cuts the lineage, so a lost executor does not force a
    re-shuffle with new range bounds.
    """
    from helpdeck.session import checkpoint_dir

    partition = partition or []
    spark = df.sparkSession
    checkpoint_dir(spark)   # the shared folder from spark.checkpoint.dir (set only where unset)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *partition, *order).withColumn("_part", F.spark_partition_id())
    w_local = Window.partitionBy("_part", *partition).orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(w_local)).checkpoint(eager=True)
    sizes = local.groupBy("_part", *partition).agg(F.max("_local").alias("_size"))
    w_off = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(w_off), F.lit(0))).drop("_size")
    # one row per (range, partition key): at most ranges x distinct keys rows, joined on equality
    return (local.join(offsets, ["_part", *partition])
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_part", "_local", "_off"))


def next_ids(new_rows: DataFrame, existing: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """I14 auto-increment: new ids continue after the existing maximum, in ``order`` (columns, unique and not NULL)."""
    mx = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()   # scalar subquery
    numbered = running(cut(new_rows, order), [], order, {"_n": ("sum", F.lit(1))})
    return numbered.withColumn(id_col, mx + F.col("_n") + 1).drop("_n", "_p")


def _year_prefix(no: Column, year: str) -> Column:
    """``no LIKE 'SC-<year>-%'``: ASCII letters in either case, each form a prefix that the scan can prune by."""
    cond = F.lit(False)
    for sc in ("SC", "sc", "Sc", "sC"):
        cond = cond | no.startswith(f"{sc}-{year}-")
    return cond


def _number_part(no: Column) -> Column:
    """The number a ticket number continues from: ``parseInt`` of its third part (a struct, whose ``num`` is NULL for NaN)."""
    return F.struct(parse_int(F.get(F.split(no, "-", -1), F.lit(2))).alias("num"))


def _next_number(year: Column, base: Column, k: Column) -> Column:
    """The ``k``-th number generated after ``base``. After one that is no number, the first is written
    ``000NaN``; that one reads as 0, so counting starts anew behind it."""
    num = F.when(base["num"].isNotNull(), base["num"] + k).when(k > 1, (k - 1).cast("decimal(38,0)"))
    return F.concat(F.lit("SC-"), year, F.lit("-"), F.coalesce(zero_pad(num, 6), F.lit("000NaN")))


def _carried(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` (cut; ``_auto``: 1 where a number is to be generated, ``_given``: what a given number of the key reads as,
    else NULL) with ``_pos`` (earlier rows of the key), ``_base`` (the latest given number before the row, or NULL) and ``_k``
    (how many numbers have been generated since, the row's own included)."""
    counted = running(rows, keys, order, {"_pos": ("sum", F.lit(1)), "_autos": ("sum", F.col("_auto"))})
    mark = F.when(F.col("_given").isNotNull(), F.struct(F.col("_given").alias("g"), F.col("_autos").alias("at")))
    out = running(counted, keys, order, {"_mark": ("last", mark)})
    return (out.withColumn("_base", F.col("_mark.g"))
            .withColumn("_k", F.col("_autos") - F.coalesce(F.col("_mark.at"), F.lit(0)) + 1).drop("_mark", "_autos"))


def ticket_numbers(existing: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """E2 ticket numbers ``SC-<year>-<6 digits>`` for a batch, per request year.

    A generated number follows the number of the *last inserted* ticket of its year (highest id, not highest
    number - as the reference does), and that may be one that an earlier request of the batch brought along.
    ``requests``: ``year``, the unique ``order`` columns, and where it has a ``ticket_no`` (not NULL or '') that one is kept.
    Only keys and given numbers are scanned (``pieces.running``); the numbers join back by ``order``.
    """
    no = F.nullif(F.col("ticket_no"), F.lit("")) if "ticket_no" in requests.columns else F.lit(None).cast("string")
    keys = requests.select(*order, F.col("year").cast("string").alias("_y"), no.alias("_no"))
    own = F.regexp_extract("_no", r"(?i)^SC-([0-9]+)-", 1)
    keys = keys.select(*order, F.when(F.col("_no").isNull(), F.col("_y")).otherwise(own).alias("_y"),
                       F.col("_no").isNull().cast("int").alias("_auto"),
                       F.when(own != "", _number_part(F.col("_no"))).alias("_given")).filter(F.col("_y") != "")
    done = _carried(cut(keys, order), ["_y"], order).filter(F.col("_auto") == 1)
    stored = (existing.filter(F.col("ticket_no").rlike("(?i)^SC-[0-9]+-"))
              .groupBy(F.regexp_extract("ticket_no", r"(?i)^SC-([0-9]+)-", 1).alias("_y"))
              .agg(F.max_by("ticket_no", "id").alias("_last")).select("_y", _number_part(F.col("_last")).alias("_stored")))
    zero = F.struct(F.lit(0).cast("decimal(38,0)").alias("num"))
    done = done.join(stored, "_y", "left").select(
        *order, _next_number(F.col("_y"), F.coalesce("_base", "_stored", zero), F.col("_k")).alias("_generated"))
    out = requests.withColumn("_own", no).drop("ticket_no").join(done, order, "left")
    return out.withColumn("ticket_no", F.coalesce("_own", "_generated")).drop("_own", "_generated")


def ticket_intake(existing: DataFrame, raw: DataFrame, now: str, order: list) -> DataFrame:
    """A11 + H1 + H3 + H16 + E2 + I14 new tickets from raw form rows.

    Text fields are trimmed and cut like ``trimStr``; rows whose raw customer
    name or complaint is NULL or '' are refused (one of white space only is stored as ''); valid
    rows get status 'waiting', follow-up count 0, created/updated time =
    ``now`` (a text), the next ids and, where the form gives no ``ticket_no``, this
    year's next ticket numbers, which continue from numbers given earlier in the batch too. Form columns that ``raw`` lacks are NULL paths
    or '' texts; upload paths are kept as given.
    """
    from helpdeck.functions.dates import iso_to_dmy, today_str

    def form(c: str) -> Column:
        return F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")

    cleaned = raw.filter(given("customer_name") & given("keluhan")).select(
        *order, *[trim_str(form(c), n).alias(c) for c, n in INTAKE_LIMITS.items()], *[form(c).alias(c) for c in INTAKE_PATHS],
        F.coalesce(F.nullif(F.col("tanggal_complaint"), F.lit("")), today_str(now)).alias("tanggal_complaint"),
        iso_to_dmy(F.col("tanggal_pembelian")).alias("tanggal_pembelian"),
        F.col("product_id").cast("long").alias("product_id"), F.col("created_by").cast("long").alias("created_by"),
        F.nullif(form("ticket_no"), F.lit("")).alias("_given_no"))
    # only the order and the given numbers are scanned; the texts meet their number in one join
    year = str(now)[:4]
    ours = _year_prefix(F.col("_given_no"), year)
    keys = cleaned.select(*order, F.col("_given_no").isNull().cast("int").alias("_auto"),
                          F.when(ours, _number_part(F.col("_given_no"))).alias("_given"))
    numbers = _carried(cut(keys, order), [], order)
    stored = existing.filter(_year_prefix(F.col("ticket_no"), year)).agg(F.max_by("ticket_no", "id").alias("no")).select(
        F.when(F.col("no").isNull(), F.struct(F.lit(0).cast("decimal(38,0)").alias("num"))).otherwise(_number_part(F.col("no"))).alias("b")).scalar()
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    numbers = numbers.select(*order, (highest + F.col("_pos") + 1).alias("id"),
                             _next_number(F.lit(year), F.coalesce(F.col("_base"), stored), F.col("_k")).alias("_generated"))
    rows = cleaned.join(numbers, order).withColumn("ticket_no", F.coalesce("_given_no", "_generated"))
    now_txt = F.date_format(now_ts(now), TS_FMT)
    return rows.select(
        "id", "ticket_no", "created_by", "product_id", "tanggal_complaint", *INTAKE_LIMITS, *INTAKE_PATHS,
        "tanggal_pembelian", F.lit("waiting").alias("status"), F.lit(0).alias("follow_up_count"),
        now_txt.alias("created_at"), now_txt.alias("updated_at"))


# ----------------------------------------------------------------- upserts
def import_rows(sheet: DataFrame, row_col: str = "row_no") -> DataFrame:
    """A4 + H14-H16 clean product-sheet rows: header aliases (first non-empty
    wins), trimmed code/name/type, digits-only warranty, validity."""
    def pick(*names):
        present = [n for n in names if n in sheet.columns]
        return first_truthy(*[F.col(f"`{n}`") for n in present]) if present else F.lit("")

    kode = js_trim(pick("Kode Barang", "kode_barang", "KODE_BARANG"))
    nama = js_trim(pick("Nama Produk", "nama_produk", "NAMA_PRODUK"))
    tipe = js_trim(pick("Tipe", "tipe", "TIPE"))
    gar_raw = F.coalesce(F.nullif(pick("Garansi", "garansi", "garansi_bulan"), F.lit("")), F.lit("0"))
    return sheet.select(F.col(row_col).alias("row_no"), kode.alias("kode_barang"), nama.alias("nama_produk"),
                        tipe.alias("tipe"), digits_int(gar_raw).alias("garansi_bulan"),
                        ((kode != "") & (nama != "")).alias("valid"))


def product_import_counts(sheet: DataFrame, row_col: str = "row_no") -> DataFrame:
    """D19 imported / skipped counters (every valid row counts as imported,
    repeats included, as the reference counts them)."""
    r = import_rows(sheet, row_col)
    return r.agg(F.count_if(F.col("valid")).alias("imported"), F.count_if(~F.col("valid")).alias("skipped"))


def first_and_last(incoming: DataFrame, key: str, order: str, first_cols: list[str], last_cols: list[str],
                   last_given: tuple = ()) -> DataFrame:
    """Per key: ``_first`` (its first place in ``order``) and ``_n_<column>``: ``first_cols`` from the first row,
    ``last_cols`` from the last, ``last_given`` the last that is not NULL. One partial aggregate."""
    o = F.col(order)
    aggs = [F.min(o).alias("_first")]
    aggs += [F.min_by(F.struct(F.col(c).alias("v")), o).alias(f"_s_{c}") for c in first_cols]
    aggs += [F.max_by(F.struct(F.col(c).alias("v")), o).alias(f"_s_{c}") for c in last_cols]
    aggs += [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), o)).alias(f"_s_{c}") for c in last_given]
    names = [*first_cols, *last_cols, *last_given]
    return incoming.groupBy(key).agg(*aggs).select(key, "_first", *[F.col(f"_s_{c}.v").alias(f"_n_{c}") for c in names])


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: str, order: str, id_col: str = "id",
                  update_cols: list[str] | None = None, defaults: dict[str, Column] | None = None,
                  ids_after: DataFrame | None = None) -> DataFrame:
    """I4 upsert on a natural key, as the rows would do one after the other: the
    first incoming row of an unknown key inserts (it fixes the id order and every column
    that updates leave alone), later ones update, so ``update_cols`` come from the last row (E6).
    ``defaults``: columns of new rows that the incoming rows lack; ``ids_after``: the table whose highest id new
    ids follow (default: ``existing``). Returns the whole new table."""
    update_cols = [c for c in update_cols or [c for c in existing.columns if c not in (id_col, key)] if c in incoming.columns]
    inc = first_and_last(incoming, key, order, [c for c in existing.columns if c in incoming.columns and c not in (id_col, key, *update_cols)],
                         update_cols)
    j = existing.join(inc, key, "left")
    updated = j.select(*[F.when(F.col("_first").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
                         if c in update_cols else F.col(c) for c in existing.columns])
    new = inc.join(existing.select(key), key, "left_anti")
    new_rows = next_ids(new, existing if ids_after is None else ids_after, ["_first"], id_col)
    defaults = defaults or {}
    new_rows = new_rows.select(*[F.col(f"_n_{c}").alias(c) if f"_n_{c}" in new_rows.columns
                                 else (F.col(c) if c in new_rows.columns else defaults.get(c, F.lit(None))).alias(c)
                                 for c in existing.columns])
    dtypes = dict(existing.dtypes)
    return updated.unionByName(new_rows.select(*[F.col(c).cast(dtypes[c]) for c in existing.columns]))


def product_import(products: DataFrame, sheet: DataFrame, now: str, row_col: str = "row_no") -> DataFrame:
    """A4 + E6 + I4 product import: valid rows upserted by code, last row wins; new products get the time ``now``."""
    r = import_rows(sheet, row_col).filter(F.col("valid")).drop("valid")
    return upsert_by_key(products, r, "kode_barang", "row_no", update_cols=["nama_produk", "tipe", "garansi_bulan"],
                         defaults={"created_at": F.date_format(now_ts(now), TS_FMT)})


def schedule_upsert(schedules: DataFrame, requests: DataFrame, ids_after: DataFrame | None = None) -> DataFrame:
    """I4 schedule by ticket: each valid request updates *every*
    schedule row of its ticket (there is no unique key), or inserts one: the last one's values
    stay, author, time and id order are those of the first.
    ``requests``: seq, ticket_id, teknisi_id, tanggal, jam, notes, user_id, ts."""
    from helpdeck.functions.dates import iso_to_dmy

    r = (requests.filter(given("teknisi_id") & given("tanggal") & given("jam"))
         .withColumn("tanggal", iso_to_dmy(F.col("tanggal")))
         .withColumns({"created_by": F.col("user_id"), "created_at": F.col("ts")}))
    return upsert_by_key(schedules, r, "ticket_id", "seq", update_cols=["teknisi_id", "tanggal", "jam", "notes"],
                         ids_after=ids_after)


def schedule_replay(schedules: DataFrame, log: DataFrame) -> DataFrame:
    """I4 + I6 the schedules after an ordered log of requests and cancellations (``kind`` 'schedule',
    'calendar_schedule', 'cancel_schedule'; other kinds and requests with a value missing are ignored).

    A cancellation deletes every row of its ticket, known or not, so only what follows a ticket's last one counts:
    ``schedule_upsert`` on the rows left. New ids follow the highest old id in log order; rows that the
    same log deletes again take none. ``log``: the columns of ``schedule_upsert``'s requests and ``kind``."""
    gone = (log.filter(F.col("kind") == "cancel_schedule").groupBy("ticket_id")
            .agg(F.max("seq").alias("_gone")))
    left = schedules.join(gone, "ticket_id", "left_anti").select(*schedules.columns)
    later = (log.filter(F.col("kind").isin("schedule", "calendar_schedule")).join(gone, "ticket_id", "left")
             .filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone", "kind"))
    return schedule_upsert(left, later, ids_after=schedules)


KEEP_IF_NULL = ("foto_sebelum_path", "foto_sesudah_path", "video_path")


def visit_upsert(visits: DataFrame, reports: DataFrame, now: str) -> DataFrame:
    """I3 + I4 visit result by ticket: each report updates every row of its ticket (a
    file path that it lacks stays, so the last one given counts) or inserts (technician and id order are those of the
    first); reports without findings (NULL or '') are refused. ``reports``: seq, ticket_id, teknisi_id, findings,
    solusi, sparepart, tanggal_selesai, jam."""
    from helpdeck.functions.dates import iso_to_dmy, today_str

    today = today_str(now)
    ok = reports.filter(given("findings"))
    ok = ok.select("ticket_id", "seq", "teknisi_id", today.alias("tanggal"), "jam",
                   trim_str(F.col("findings"), 2000).alias("hasil_pemeriksaan"),
                   trim_str(F.col("solusi"), 1000).alias("solusi"),
                   trim_str(F.col("sparepart"), 500).alias("sparepart"),
                   F.coalesce(iso_to_dmy(F.nullif(F.col("tanggal_selesai"), F.lit(""))), today).alias("tanggal_selesai"),
                   *[F.col(c) for c in KEEP_IF_NULL if c in reports.columns])
    repl = ("tanggal", "jam", "hasil_pemeriksaan", "solusi", "sparepart", "tanggal_selesai")
    keep = tuple(c for c in KEEP_IF_NULL if c in ok.columns and c in visits.columns)
    vals = first_and_last(ok, "ticket_id", "seq", ["teknisi_id"], list(repl), keep)
    j = visits.join(vals, "ticket_id", "left")
    hit = F.col("_first").isNotNull()
    updated = j.select(*[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in repl
                         else F.when(hit, F.coalesce(F.col(f"_n_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
                         if c in keep else F.col(c) for c in visits.columns])
    new = vals.join(visits.select("ticket_id"), "ticket_id", "left_anti")
    new = next_ids(new, visits, ["_first"])
    dtypes = dict(visits.dtypes)
    now_txt = F.date_format(now_ts(now), TS_FMT)
    new_rows = new.select(*[(F.col(f"_n_{c}") if f"_n_{c}" in new.columns else
                             now_txt if c == "created_at" else
                             F.col(c) if c in new.columns else F.lit(None)).cast(dtypes[c]).alias(c)
                            for c in visits.columns])
    return updated.unionByName(new_rows)


def settings_replace(settings: DataFrame, writes: DataFrame, order: str = "seq") -> DataFrame:
    """I5 insert-or-replace by key: the last write per key wins over the stored value."""
    old = settings.select("key", "value", F.lit(-1).cast("long").alias(order))
    allw = old.unionByName(writes.select("key", "value", F.col(order).cast("long")))
    return last_per_key(allw, "key", order).select("key", "value")


def keyed_update(table: DataFrame, updates: DataFrame, key: str = "id", order: str = "seq",
                 cols: list[str] | None = None) -> DataFrame:
    """I2 ``UPDATE t SET c.. WHERE key = ?`` for a batch: last update per key
    replaces the listed columns (NULL included, as a SET does)."""
    cols = cols or [c for c in updates.columns if c not in (key, order)]
    last = last_per_key(updates, key, order)
    u = last.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = table.join(u, key, "left")
    dtypes = dict(table.dtypes)
    return j.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).cast(dtypes[c]).alias(c)
                      if c in cols else F.col(c) for c in table.columns])


def toggle_active(users: DataFrame, requests: DataFrame) -> DataFrame:
    """I11 flip ``active`` for technicians named in a batch; each request flips
    once, so an even number of requests for one user leaves it unchanged."""
    n = requests.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("_flips"))
    j = users.join(n, "id", "left")
    flip = (F.col("role") == "teknisi") & (F.coalesce(F.col("_flips"), F.lit(0)) % 2 == 1)
    # the reference writes ``active ? 0 : 1``: any truthy value becomes 0
    new = F.when(flip, F.when(F.coalesce(F.col("active"), F.lit(0)) != 0, F.lit(0)).otherwise(F.lit(1))) \
        .otherwise(F.col("active"))
    return j.withColumn("active", new.cast(dict(users.dtypes)["active"])).select(*users.columns)


def guarded_user_delete(users: DataFrame, requests: DataFrame) -> DataFrame:
    """D20 + I6 a batch of user deletes in ``seq`` order: unknown users and
    invalid roles are refused; an admin delete is refused when it would remove
    the last admin. Returns (seq, user_id, role, deleted, reason).

    Only admin deletes compete for the guard; they are numbered in order (a
    set bounded by the number of admins) and the first ``admins - 1`` pass. A repeated request
    finds no user after a delete, and meets the same refusal after one that was refused."""
    first = (requests.groupBy("user_id").agg(F.min("seq").alias("seq")))
    dup = requests.join(first.withColumnRenamed("seq", "_first"), "user_id") \
        .filter(F.col("seq") != F.col("_first")).select("seq", "user_id")
    j = first.join(users.select(F.col("id").alias("user_id"), "role"), "user_id", "left")
    n_admins = users.filter(F.col("role") == "admin").agg(F.count(F.lit(1))).scalar()   # scalar subquery
    adm = j.filter(F.col("role") == "admin")
    adm = sequence_numbers(adm, ["seq"], name="_k")
    adm = adm.withColumn("deleted", F.col("_k") < n_admins).withColumn(
        "reason", F.when(F.col("deleted"), F.lit("deleted")).otherwise(F.lit("cannot_delete_last_admin")))
    other = j.filter(F.col("role").isNull() | (F.col("role") != "admin"))
    other = other.withColumn("deleted", F.coalesce(F.col("role").isin("management", "teknisi", "cs"),
                                                   F.lit(False))).withColumn(
        "reason", F.when(F.col("role").isNull(), F.lit("user_not_found"))
        .when(F.col("deleted"), F.lit("deleted")).otherwise(F.lit("invalid_role")))
    cols = ["seq", "user_id", "role", "deleted", "reason"]
    done = adm.select(*cols).unionByName(other.select(*cols))
    gone = F.col("_d")
    was = done.select("user_id", F.col("role").alias("_r"), F.col("deleted").alias("_d"), F.col("reason").alias("_why"))
    dups = dup.join(was, "user_id").select("seq", "user_id", F.when(~gone, F.col("_r")).alias("role"), F.lit(False).alias("deleted"),
                                           F.when(gone, F.lit("user_not_found")).otherwise(F.col("_why")).alias("reason"))
    return done.unionByName(dups)


def cascade_link_ids(notifications: DataFrame, match: str = "contains") -> DataFrame:
    """(notification id, ticket id text) pairs a cascade delete would match.

    ``contains`` (reference parity): ``link LIKE '%/admin/tickets/<id>%'``,
    so id 1 also matches links of 10-19, 100...; expressed as: for each
    occurrence of the path, every prefix of the digits after it, joined
    by equality - no LIKE join. ``exact``: the whole digit run only.
    """
    occ = F.regexp_extract_all(F.col("link"), F.lit(r"(?i)/admin/tickets/(-?[0-9]*)"), F.lit(1))
    n = notifications.select("id", F.explode(occ).alias("_digits")).filter(F.length("_digits") > 0)
    if match == "exact":
        return n.select("id", F.col("_digits").alias("tid"))
    pre = F.transform(F.sequence(F.lit(1), F.length("_digits")), lambda i: F.substring(F.col("_digits"), 1, i))
    return n.select("id", F.explode(pre).alias("tid")).filter(F.col("tid") != "-").distinct()


def cascade_delete(tables: dict, ticket_ids: DataFrame, match: str = "contains") -> dict:
    """I8 delete tickets with their visits, activity, schedules and the
    notifications whose link mentions them. Returns the new tables.
    Approval logs and vouchers remain, as in the reference."""
    ids = ticket_ids.select(F.col("id").cast("long").alias("id")).distinct()
    tid = ids.withColumnRenamed("id", "ticket_id")
    out = dict(tables)
    out["tickets"] = tables["tickets"].join(ids, "id", "left_anti")
    for t in ("visit_results", "activity_log", "schedules"):
        out[t] = tables[t].join(tid, "ticket_id", "left_anti")
    hits = cascade_link_ids(tables["notifications"], match).join(
        ids.select(F.col("id").cast("string").alias("tid")), "tid", "left_semi").select("id").distinct()
    out["notifications"] = tables["notifications"].join(hits, "id", "left_anti")
    return out


def reset_plan(tables: dict, total: bool = False) -> dict:
    """I7 reset: visits, activity, notifications, schedules and tickets
    emptied (schema kept); a total reset also empties products and keeps only
    admin users."""
    out = dict(tables)
    for t in ("visit_results", "activity_log", "notifications", "schedules", "tickets"):
        out[t] = tables[t].limit(0)
    if total:
        out["products"] = tables["products"].limit(0)
        out["users"] = tables["users"].filter(F.col("role") == "admin")
    return out


def activity_backfill(tickets: DataFrame) -> DataFrame:
    """A10 ``INSERT ... SELECT`` with literals: a creation row for every
    ticket, an approval row for scheduled/on-progress/completed ones and a
    close row for completed ones."""
    def rows(df, user, action, desc):
        return df.select(F.col("id").alias("ticket_id"), F.lit(user).cast("long").alias("user_id"),
                         F.lit(action).alias("action"), F.lit(desc).alias("description"))
    return (rows(tickets, 1, "create", "Ticket dibuat")
            .unionByName(rows(tickets.filter(F.col("status").isin("scheduled", "on_progress", "completed")),
                              2, "approve", "Disetujui Management"))
            .unionByName(rows(tickets.filter(F.col("status") == "completed"), 1, "close", "Ticket ditutup")))


def voucher_candidates(tickets: DataFrame, products: DataFrame, vouchers: DataFrame, now: str,
                       salt: str, given_expiry=None) -> DataFrame:
    """I13 tickets approved (approved_by set) without a voucher, with the
    voucher snapshot: customer and product fields, decision, token (H26) and
    expiry (H24). The token opens a public page: ``salt`` must be secret and new for each batch."""
    t = tickets.filter(F.col("approved_by").isNotNull() & (F.col("approved_by") != 0))
    t = t.join(vouchers.select(F.col("ticket_id").alias("id")), "id", "left_anti")
    p = products.select(F.col("id").alias("_pid"), "nama_produk", "tipe")
    t = t.join(p, t["product_id"] == p["_pid"], "left")
    return t.select(
        F.col("id").alias("ticket_id"), "customer_name", "customer_hp", "customer_alamat",
        F.col("nama_produk").alias("product_name"), F.col("tipe").alias("product_type"),
        "serial_number", "keluhan", F.col("management_decision").alias("decision"),
        F.lit("active").alias("status"),
        F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("qr_token"),
        default_expiry(given_expiry if given_expiry is not None else F.lit(None).cast("string"), now)
        .alias("expired_at"))


def voucher_number(number: Column, now: str) -> Column:
    """H25 ``BRC-<base36 ms>-<6 chars>``, upper-case; the suffix is the voucher's id in base 36
    (at least 6 digits) instead of random digits, so no two vouchers share a number."""
    from helpdeck.functions.dates import epoch_seconds

    ms = (epoch_seconds(now_ts(now)) * 1000).cast("string")
    digits = F.conv(number.cast("string"), 10, 36)
    suffix = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    return F.upper(F.concat(F.lit("BRC-"), F.conv(ms, 10, 36), F.lit("-"), suffix))


def issue_vouchers(tickets: DataFrame, products: DataFrame, vouchers: DataFrame, now: str, salt: str,
                   created_by: int = 1) -> DataFrame:
    """I13 new voucher rows: candidates + next ids + voucher number."""
    c = voucher_candidates(tickets, products, vouchers, now, salt)
    c = c.withColumn("created_by", F.lit(created_by).cast("long")) \
         .withColumn("created_at", F.date_format(now_ts(now), TS_FMT))
    c = next_ids(c, vouchers, ["ticket_id"])
    return c.withColumn("voucher_no", voucher_number(F.col("id"), now))


def creation_events(new_tickets: DataFrame) -> DataFrame:
    """I12 the activity row that each new ticket writes: (ticket_id, user_id, action, description, created_at)."""
    action, text = CREATED_TEXT
    return new_tickets.select(F.col("id").alias("ticket_id"), F.col("created_by").alias("user_id"),
                              F.lit(action).alias("action"), F.lit(text).alias("description"), "created_at")


def voucher_notifications(new_vouchers: DataFrame, tickets: DataFrame) -> DataFrame:
    """I12 the notification that each issued voucher sends to its ticket's creator (none without a creator, NULL or 0):
    (user_id, message, link). NULL names read 'null', as the reference writes them."""
    t = tickets.select(F.col("id").alias("ticket_id"), F.col("created_by").alias("_creator"))
    v = new_vouchers.withColumn("customer_name", F.coalesce("customer_name", F.lit("null")))
    return (v.join(t, "ticket_id").filter(F.col("_creator") != 0)
            .select(F.col("_creator").alias("user_id"), _fill(VOUCHER_ISSUED_TEXT).alias("message"),
                    F.concat(F.lit("/admin/voucher/"), F.col("id").cast("string")).alias("link")))


def voucher_sent_events(requests: DataFrame, vouchers: DataFrame, tickets: DataFrame) -> DataFrame:
    """I12 the activity row of each request (seq, ticket_id, user_id) to send a ticket's voucher: written only where
    the ticket has a voucher and a phone; the phone is the ticket's, not the voucher's."""
    action, text = VOUCHER_SENT_TEXT
    t = tickets.filter(given("customer_hp")).select(F.col("id").alias("ticket_id"), "customer_hp")
    return (requests.join(vouchers.select("ticket_id"), "ticket_id", "left_semi").join(t, "ticket_id")
            .select("seq", "ticket_id", "user_id", F.lit(action).alias("action"), _fill(text).alias("description")))


# ---- fixed values (must equal the reference) -------------------------------
NOTIFY_DIRECT = {
    "analysis": [("role", "management", "Ticket membutuhkan approval Anda", "/management/approval"),
                 ("creator", None, "Ticket {no} sudah dikirim ke Management untuk approval", "/admin/tickets/{id}")],
    "followup": [("role", "management", "Follow-up ticket membutuhkan re-approval Anda", "/management/approval"),
                 ("creator", None, "Follow-up {no} sudah dikirim ke Management", "/admin/tickets/{id}")],
    "schedule": [("technician", None, "Anda mendapat jadwal kunjungan baru", "/teknisi/visit/{id}")],
    "calendar_schedule": [("technician", None, "Anda mendapat jadwal kunjungan baru {tanggal} {jam}",
                           "/teknisi/visit/{id}")],
    "cancel_schedule": [("scheduled_technician", None, "Jadwal kunjungan dibatalkan", "/teknisi/visit/{id}")],
}
NOTIFY_FANOUT = {
    ("approve", "admin"): "Ticket disetujui Management, silakan buat jadwal",
    ("approve", "cs"): "Ticket {no} disetujui Management",
    ("reject", "admin"): "Ticket ditolak oleh Management",
    ("reject", "cs"): "Ticket {no} ditolak Management",
    ("reset", "admin"): "Ticket {no} perlu approval ulang",
    ("reset", "cs"): "Ticket {no} perlu approval ulang",
    ("visit_result_followup", "admin"): "Hasil kunjungan: butuh follow-up dari Admin",
    ("visit_result", "admin"): "Teknisi telah mengupload hasil kunjungan untuk ticket",
}
# -----------------------------------------------------------------------------


def emit_notifications(tickets: DataFrame, changes: DataFrame, users: DataFrame,
                       schedules: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """I12 notification rows the accepted changes write: (seq, ticket_id,
    user_id, role, message, link).

    Role- and user-addressed rows come straight from the scanned changes; the
    admin/cs fan-outs join the measured recipients (``key_join``). A schedule
    cancellation notifies the technician whom the ticket's schedule names at that time: the one of the latest request
    earlier in the batch, none after an earlier cancellation, else the one of the ticket's first row in ``schedules``.
    """
    from helpdeck.operators.enrich import first_per_key
    from helpdeck.operators.joins import key_join

    s = scan_changes(tickets, changes) if scanned is None else scanned
    kind = F.col("kind")
    s = s.filter(F.col("writes"))
    t = tickets.select(F.col("id").alias("_tid"), "ticket_no", "created_by")
    first_s = first_per_key(schedules, "ticket_id", "id", ["teknisi_id"]).select(
        F.col("ticket_id").alias("_sid"), F.col("teknisi_id").alias("_sched_tek"))
    s = s.join(t, s["ticket_id"] == t["_tid"], "left").drop("_tid") \
         .join(first_s, s["ticket_id"] == first_s["_sid"], "left").drop("_sid")
    s = s.withColumn("_sched_tek", F.when(F.col("schedule_before").isNotNull(), F.col("schedule_before.teknisi_id"))
                     .otherwise(F.col("_sched_tek")))
    no = F.coalesce(F.col("ticket_no"), F.concat(F.lit("#"), F.col("ticket_id").cast("string")))

    def text(tpl: str) -> Column:
        return _fill(tpl.replace("{no}", "{_no}").replace("{id}", "{ticket_id}"))

    s = s.withColumn("_no", no)
    # every direct (role- or user-addressed) row of a change in one pass: one
    # optional struct per template, exploded after dropping the absent ones
    users_of = {"role": F.lit(None).cast("long"), "creator": F.col("created_by"),
                "technician": F.col("teknisi_id"), "scheduled_technician": F.col("_sched_tek")}
    wanted = {"role": F.lit(True), "creator": F.col("created_by").isNotNull() & (F.col("created_by") != 0),
              "technician": F.lit(True), "scheduled_technician": F.col("_sched_tek").isNotNull()}
    rows = []
    for k, templates in NOTIFY_DIRECT.items():
        for target, role, msg, link in templates:
            rows.append(F.when((kind == k) & wanted[target], F.struct(
                users_of[target].cast("long").alias("user_id"), F.lit(role).cast("string").alias("role"),
                text(msg).alias("message"), text(link).alias("link"))))
    direct = (s.select("seq", "ticket_id", F.explode(F.array_compact(F.array(*rows))).alias("_d"))
              .select("seq", "ticket_id", "_d.user_id", "_d.role", "_d.message", "_d.link"))
    fan_kind = F.when((kind == "visit_result") & needs_followup(F.col("solusi")), F.lit("visit_result_followup")) \
        .otherwise(kind)
    targets = []
    for (k, r), msg in NOTIFY_FANOUT.items():
        targets.append(F.when(fan_kind == k, F.struct(F.lit(r).alias("role"), text(msg).alias("message"))))
    ev = (s.filter(kind.isin("approve", "reject", "reset", "visit_result"))
          .select("seq", "ticket_id", F.concat(F.lit("/admin/tickets/"), F.col("ticket_id").cast("string")).alias("link"),
                  F.explode(F.array_compact(F.array(*targets))).alias("_t"))
          .select("seq", "ticket_id", "_t.role", "_t.message", "link"))  # built once, before a change meets its recipients
    recipients = users.filter(F.col("role").isin("admin", "cs")).select(F.col("id").alias("user_id"), "role")
    fan = key_join(ev, recipients, ["role"], salt_source=F.hash("seq")).select(
        "seq", "ticket_id", "user_id", F.lit(None).cast("string").alias("role"), "message", "link")
    return fan.unionByName(direct)
