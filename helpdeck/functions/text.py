"""Text Column expressions.

Every function takes and returns ``pyspark.sql.Column`` and uses only
built-in Spark functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helpdeck.functions._util import as_col, lit_or_col

# JavaScript String.prototype.trim removes TAB, LF, VT, FF, CR, every Unicode
# separator (Zs, and the line/paragraph separators Zl/Zp) and U+FEFF.
# Spark's plain ``trim`` removes only U+0020. The class is spelled out so the
# same text works in Java regex (Spark) and RE2 (the DuckDB oracle).
WS_CLASS = r"[\t\n\x0B\f\r \p{Z}\x{FEFF}]"
_WS = WS_CLASS
_EDGE_WS = rf"^{_WS}+|{_WS}+$"


def js_trim(c) -> Column:
    """Trim all leading/trailing white space the way JS ``trim`` does."""
    return F.regexp_replace(as_col(c), _EDGE_WS, "")


def trim_str(c, max_len: int = 500) -> Column:
    """H1 ``trimStr``: NULL -> '', trim all white space, cut to ``max_len`` chars."""
    return F.substring(js_trim(F.coalesce(as_col(c).cast("string"), F.lit(""))), 1, max_len)


def is_blank(c) -> Column:
    """True when the value is NULL or only white space (JS falsy after trim)."""
    c = as_col(c)
    return c.isNull() | (js_trim(c) == F.lit(""))


def nonblank(c) -> Column:
    return ~is_blank(c)


def zero_pad(c, width: int) -> Column:
    """H12 ``padStart(width,'0')``: pads but never truncates.

    ``lpad`` alone cuts strings longer than ``width``; keep those unchanged.
    """
    s = as_col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def digits_int(c) -> Column:
    """H15 digits-only integer, else 0 (``'12.5 bulan'`` -> 125)."""
    digits = F.regexp_replace(F.coalesce(as_col(c).cast("string"), F.lit("")), "[^0-9]", "")
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def first_truthy(*cols) -> Column:
    """H14 header alias choice: first value that is not NULL and not ''."""
    return F.coalesce(*[F.nullif(as_col(c).cast("string"), F.lit("")) for c in cols], F.lit(""))


def normalize_phone(c) -> Column:
    """H17: keep digits, leading 0 -> 62, must then start with 62, else NULL."""
    raw = as_col(c)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    intl = F.when(digits.startswith("0"), F.concat(F.lit("62"), F.substring(digits, 2, 1 << 30))) \
        .otherwise(digits)
    return F.when(raw.isNotNull() & (raw != "") & intl.startswith("62"), intl)


def app_link(base_url, path) -> Column:
    """H19: '' when no base URL, else newline + URL without trailing '/' + path."""
    url = lit_or_col(base_url)
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit("\n"), F.regexp_replace(url, "/+$", ""), F.coalesce(lit_or_col(path), F.lit("")))
    )


def status_upper(c) -> Column:
    """H28 print form: upper-case, first '_' replaced by a space."""
    return F.regexp_replace(F.upper(as_col(c)), "^([^_]*)_", "$1 ")


def text_lines(c) -> Column:
    """H29: text block -> array of trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(F.coalesce(as_col(c), F.lit("")), "\n"), js_trim),
                    lambda x: x != "")


def strip_quotes(c) -> Column:
    """H31: remove single quotes from chart labels."""
    return F.translate(as_col(c), "'", "")


def dash_if_blank(c) -> Column:
    """H30: missing (NULL or '') -> '-'."""
    return F.coalesce(F.nullif(as_col(c).cast("string"), F.lit("")), F.lit("-"))


def truncate(c, n: int) -> Column:
    """H27 display truncation to ``n`` characters."""
    return F.substring(as_col(c), 1, n)


def file_extension(c) -> Column:
    """H32 ``path.extname``: from the last '.' of the base name; '' if none
    or if the only dot starts the name."""
    base = F.regexp_extract(as_col(c), r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^.+?(\.[^.]*)$", 1)


def public_path(c) -> Column:
    """H32 ``imgUrl``: '' for missing, as is when it starts with 'http',
    else under /uploads/."""
    p = as_col(c)
    return (F.when(p.isNull() | (p == ""), F.lit(""))
            .when(p.startswith("http"), p)
            .otherwise(F.concat(F.lit("/uploads/"), p)))


def parse_int(c: Column) -> Column:
    """``parseInt`` of a text as ``decimal(38,0)``: leading blanks and a sign, then digits (or ``0x`` and hexadecimal ones);
    what follows is ignored, and NULL stands for NaN. Whole numbers are exact here, beyond 2**53 too."""
    t = js_trim(c)
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    hexa = F.regexp_extract(t, r"^[+-]?0[xX]([0-9a-fA-F]{1,15})", 1)
    digits = F.when(hexa != "", F.conv(hexa, 16, 10)).otherwise(F.regexp_extract(t, r"^[+-]?([0-9]+)", 1))
    return (digits.try_cast("decimal(37,0)") * sign).cast("decimal(38,0)")
