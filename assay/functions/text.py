"""Text and number forms used by reports and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.paths import NO_EXT


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ext_label(ext: Column | str) -> Column:
    e = _col(ext)
    return (
        F.when(e == NO_EXT, F.lit("No ext"))
        .when(e == "other", F.lit("Others"))
        .otherwise(F.upper(F.ltrim(e, F.lit("."))))
    )


def status_tone(status: Column | str) -> Column:
    s = _col(status)
    return F.when(s == "ok", "healthy").when(s.isin("corrupt", "unreadable"), s).otherwise("other")


def status_prefix(status: Column | str) -> Column:
    return F.initcap(F.replace(F.when(_col(status) == "ok", "healthy").otherwise(_col(status)), F.lit("_"), F.lit(" ")))


def percent_1dp(n: Column, total: Column, half_even: bool = False) -> Column:
    """Share of a whole in percent to one decimal, in integer arithmetic.

    Halves go up, as on the chart, or to the even digit, as in the type breakdown.
    """
    q, r = F.call_function("div", 1000 * n, total), (1000 * n) % total
    on_half = (q % 2 == 1) if half_even else F.lit(True)
    up = (2 * r > total) | ((2 * r == total) & on_half)
    return F.when(total > 0, (q + up.cast("long")) / F.lit(10.0)).otherwise(0.0)


def percent_int(done: Column, total: Column) -> Column:
    """Whole percent, rounded down and never above 100."""
    return F.when(total > 0, F.least(F.lit(100).cast("long"), F.floor(done / total * 100))).otherwise(
        F.lit(0).cast("long")
    )


def byte_size(size: Column | str) -> Column:
    n = _col(size)
    # Exact halves go to the even digit; format_string alone would round them up.
    one_digit = lambda unit, scale: F.format_string(f"%.1f {unit}", F.bround(n / scale, 1))
    return (
        F.when(n >= 1 << 30, one_digit("GB", 1 << 30))
        .when(n >= 1 << 20, one_digit("MB", 1 << 20))
        .otherwise(one_digit("KB", 1 << 10))
    )


def truncated(text: Column | str, width: int = 60) -> Column:
    t = _col(text)
    return F.when(F.length(t) > width, F.concat(F.left(t, F.lit(width)), F.lit("…"))).otherwise(t)


def _whole(n: Column) -> Column:
    return n.cast("long").cast("string")


def duration(seconds: Column | str) -> Column:
    """``42s``, ``3m 5s``, ``2h 10m``; zero remainders are left out, negatives are null."""
    s = F.floor(_col(seconds))
    m, h = F.floor(s / 60), F.floor(s / 3600)
    with_rest = lambda big, unit, rest, small: F.concat(
        _whole(big), F.lit(unit), F.when(rest > 0, F.concat(F.lit(" "), _whole(rest), F.lit(small))).otherwise("")
    )
    return (
        F.when(s < 0, None)
        .when(s < 60, F.concat(_whole(s), F.lit("s")))
        .when(m < 60, with_rest(m, "m", s % 60, "s"))
        .otherwise(with_rest(h, "h", m % 60, "m"))
    )


def eta_text(seconds: Column | str) -> Column:
    s = _col(seconds)
    up = F.ceil(s)
    return (
        F.when(s.isNull() | (s < 1), "")
        .when(up < 60, F.concat(_whole(up), F.lit("s remaining")))
        .otherwise(F.concat(F.lit("~"), _whole(F.ceil(up / 60)), F.lit("m remaining")))
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Exact difference in seconds as a double, for either timestamp type."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def _span(s: Column) -> Column:
    return (
        F.when(s < 60, F.concat(_whole(s), F.lit("s")))
        .when(s < 3600, F.concat(_whole(F.floor(s / 60)), F.lit("m")))
        .when(s < 86400, F.concat(_whole(F.floor(s / 3600)), F.lit("h")))
        .otherwise(F.concat(_whole(F.floor(s / 86400)), F.lit("d")))
    )


def age(ts: Column | str, as_of: Column) -> Column:
    """How long ago, against a given instant: ``just now``, ``7m ago``, ``2d ago``."""
    s = F.floor(seconds_between(_col(ts), as_of))
    return F.when(s < 5, "just now").otherwise(F.concat(_span(s), F.lit(" ago")))


def relative_time(ts: Column | str, as_of: Column) -> Column:
    """Countdown before the instant and age after it."""
    s = F.floor(seconds_between(as_of, _col(ts)) + 0.5)
    span = _span(F.abs(s))
    return (
        F.when((F.abs(s) < 5) & (s >= 0), "in a moment")
        .when(F.abs(s) < 5, "just now")
        .when(s >= 0, F.concat(F.lit("in "), span))
        .otherwise(F.concat(span, F.lit(" ago")))
    )


def counted(n: Column, noun: str) -> Column:
    """``1 issue`` or ``3 issues``."""
    return F.concat(_whole(n), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def run_outcome(state: Column | str, issues: Column, last_error: Column) -> Column:
    s = _col(state)
    return (
        F.when((s == "completed") & (issues == 0), "completed")
        .when(s == "completed", F.concat(F.lit("completed with "), counted(issues, "issue")))
        .when((s == "failed") & (F.length(last_error) > 0), last_error)
        .otherwise(s)
    )


def parse_iso_utc(text: Column | str) -> Column:
    """ISO-8601 text as a timestamp; no zone means UTC; bad text is null."""
    t = _col(text)
    zoned = F.rlike(t, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    full = (
        F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(t, F.lit("T00:00:00Z")))
        .when(zoned, t)
        .otherwise(F.concat(t, F.lit("Z")))
    )
    return full.try_cast("timestamp")
