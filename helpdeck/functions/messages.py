"""H18 message templates and H19 links, as Column expressions.

The fixed texts are kept as the reference writes them; the application name
shown to technicians is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helpdeck.functions._util import as_col, lit_or_col
from helpdeck.functions.text import app_link

# ---- fixed values (must equal the reference) -------------------------------
APPROVAL_NEEDED = "\U0001F514 *APPROVAL DIBUTUHKAN*\n\nTicket: {no}\nCustomer: {customer}\n\nAda ticket baru yang membutuhkan approval Anda."
APPROVED = "✅ *TICKET DISETUJUI*\n\nTicket: {no}\n\nManagement telah menyetujui ticket. Silakan buat jadwal teknisi."
REJECTED = "❌ *TICKET DITOLAK*\n\nTicket: {no}\n\nManagement telah menolak ticket."
SCHEDULED = "\U0001F4C5 *JADWAL KUNJUNGAN BARU*\n\nTicket: {no}\nTanggal: {tanggal}\nJam: {jam}\n\nSilakan cek aplikasi {app} untuk detail."
SCHEDULE_CANCELLED = "⚠️ *JADWAL DIBATALKAN*\n\nTicket: {no}\n\nJadwal kunjungan telah dibatalkan."
VOUCHER = ("*{brand} - VOUCHER GARANSI*\n\nYth. {customer},\n\nVoucher garansi untuk ticket {no} telah diterbitkan.\n\n"
           "No. Voucher: {voucher}\nKeputusan: {decision}\n\nScan QR atau buka link berikut untuk verifikasi:\n{link}\n\n"
           "Terima kasih telah mempercayakan produk Anda kepada kami.\n\n*{company}*")
LINK_PATHS = {"approval_needed": "/management/approval", "approved": "/admin/tickets",
              "rejected": "/admin/tickets", "scheduled": "/teknisi/dashboard",
              "schedule_cancelled": "/teknisi/dashboard"}
# -----------------------------------------------------------------------------

TEMPLATES = {"approval_needed": APPROVAL_NEEDED, "approved": APPROVED, "rejected": REJECTED,
             "scheduled": SCHEDULED, "schedule_cancelled": SCHEDULE_CANCELLED}


def render(template: str, app_name: str = "Service Desk", **fields) -> Column:
    """Fill ``{name}`` placeholders of a template with Columns (NULL field -> NULL text)."""
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        key = m.group(1)
        parts.append(F.lit(app_name) if key == "app" else as_col(fields[key]).cast("string"))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def message(kind: str, base_url=None, app_name: str = "Service Desk", **fields) -> Column:
    """Template text for ``kind`` plus the app link (H19; '' without base URL)."""
    return F.concat(render(TEMPLATES[kind], app_name, **fields),
                    app_link(lit_or_col(base_url), F.lit(LINK_PATHS[kind])))


def voucher_message(brand: str, company: str, base_url: str, **fields) -> Column:
    """The text sent with a voucher; ``fields``: customer, no, voucher, decision, token. NULLs read 'null', as the
    reference writes them; the names and the address of the public page are parameters."""
    known = {k: F.coalesce(as_col(v).cast("string"), F.lit("null")) for k, v in fields.items()}
    link = F.concat(F.lit(base_url.rstrip("/") + "/voucher/"), known.pop("token"))
    return render(VOUCHER, brand=F.lit(brand), company=F.lit(company), link=link, **known)
