"""Display-rule Column expressions.

The label texts below are fixed values that must equal the reference's for
results to match; they are kept together, in the reference's order.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from helpdeck.functions._util import as_col
from helpdeck.functions.text import js_trim

# ---- fixed values (must equal the reference) -------------------------------
STATUSES = ["waiting", "approval", "scheduled", "on_progress", "completed", "rejected"]
STATUS_LABELS = {
    "waiting": "Waiting",
    "approval": "Approval",
    "scheduled": "Scheduled",
    "on_progress": "On Progress",
    "completed": "Completed",
    "rejected": "Rejected",
}
ROLES = ["admin", "management", "teknisi", "cs"]
DECISIONS = ["Servis", "Ganti Unit", "reject"]
SOLUSI = [
    "Servis",
    "Ganti Sparepart",
    "Ganti Unit",
    "Butuh Sparepart (Follow-up)",
    "Ganti Baru (Follow-up)",
    "Tidak Bisa Diperbaiki",
]
FOLLOWUP_MESSAGES = {
    "Butuh Sparepart (Follow-up)": "Kunjungan: butuh sparepart, follow-up dari admin diperlukan",
    "Ganti Baru (Follow-up)": "Kunjungan: butuh unit baru, follow-up dari admin diperlukan",
    "Tidak Bisa Diperbaiki": "Kunjungan: tidak bisa diperbaiki, follow-up dari admin diperlukan",
}
FOLLOWUP_DEFAULT_MESSAGE = "Kunjungan: butuh follow-up dari admin"
APPROVAL_ACTION_LABELS = {"approve": "Disetujui", "reject": "Ditolak", "reset": "Reset"}
MONTH_NAMES = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus",
               "September", "Oktober", "November", "Desember"]
DAY_NAMES = ["Min", "Sen", "Sel", "Rab", "Kam", "Jum", "Sab"]
# -----------------------------------------------------------------------------


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def status_label(c) -> Column:
    """B13 status -> label, 'Unknown' for anything else (NULL included)."""
    return F.coalesce(literal_map(STATUS_LABELS)[as_col(c)], F.lit("Unknown"))


def handled_label(c, style: str = "print") -> Column:
    """B14 handled label from status: completed/on_progress -> yes, rejected -> '-', else no."""
    yes, no = ("SUDAH", "BELUM") if style == "print" else ("Sudah", "Belum")
    s = as_col(c)
    return (F.when(s.isin("completed", "on_progress"), F.lit(yes))
            .when(s == "rejected", F.lit("-"))
            .otherwise(F.lit(no)))


def purchase_channel(marketplace, toko) -> Column:
    """B15: non-blank marketplace (plus ' / shop' when the shop is non-blank);
    otherwise the shop, or '-' when the shop is NULL or ''."""
    m, t = as_col(marketplace), as_col(toko)
    m_ok = m.isNotNull() & (js_trim(m) != "")
    t_ok = t.isNotNull() & (js_trim(t) != "")
    return (F.when(m_ok & t_ok, F.concat(m, F.lit(" / "), t))
            .when(m_ok, m)
            .otherwise(F.coalesce(F.nullif(t, F.lit("")), F.lit("-"))))


def log_severity(c) -> Column:
    """B16 debug-log row class: 'error' -> danger, '_start' -> success, else ''."""
    t = as_col(c)
    return (F.when(t.contains("error"), F.lit("danger"))
            .when(t.contains("_start"), F.lit("success"))
            .otherwise(F.lit("")))


def needs_followup(solusi) -> Column:
    """B17 the visit outcome asks for an admin follow-up."""
    return F.coalesce(as_col(solusi).isin(*FOLLOWUP_MESSAGES), F.lit(False))


def followup_message(solusi) -> Column:
    """B17 activity text for a follow-up outcome (NULL when none is needed)."""
    s = as_col(solusi)
    return F.when(needs_followup(s),
                  F.coalesce(literal_map(FOLLOWUP_MESSAGES)[s], F.lit(FOLLOWUP_DEFAULT_MESSAGE)))


def approval_action_label(c) -> Column:
    """B19 approval-history outcome label; unknown actions show as is."""
    a = as_col(c)
    return F.coalesce(literal_map(APPROVAL_ACTION_LABELS)[a], a)


def approval_outcome_label(status) -> Column:
    """B19 processed-approvals badge: rejected -> Ditolak, else Disetujui."""
    return F.when(as_col(status) == "rejected", F.lit("Ditolak")).otherwise(F.lit("Disetujui"))


def voucher_state(status) -> Column:
    """B20 only ``status`` decides; ``expired_at`` is shown but never enforced."""
    return F.when(as_col(status) == "active", F.lit("AKTIF")).otherwise(F.lit("TIDAK AKTIF"))


def month_name(month_col) -> Column:
    """H23 month name, 1-based."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), as_col(month_col).cast("int"))


def day_name(dow0_col) -> Column:
    """H23 weekday short name, Sunday = 0."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), as_col(dow0_col).cast("int") + 1)


# ---- fixed values (must equal the reference) -------------------------------
ROLE_BADGES = {"admin": "primary", "management": "warning", "cs": "secondary"}
OTHER_BADGE = "info"
# -----------------------------------------------------------------------------


def role_label(c) -> Column:
    """H28 a role as it is shown: 'CS' for cs, else with its first letter in capitals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "cs", F.lit("CS")).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30)))


def role_badge(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(OTHER_BADGE)
    for role, badge in ROLE_BADGES.items():
        out = F.when(c == role, badge).otherwise(out)
    return out
