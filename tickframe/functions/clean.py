"""Cleaning of raw text fields and the columns derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import as_col

# Spellings, labels, states.
PRIORITY_SPELLINGS = {
    1: ["1", "1 - critical", "1-critical", "p1", "critical"],
    2: ["2", "2 - high", "2-high", "p2", "high"],
    3: ["3", "3 - moderate", "3-moderate", "p3", "moderate", "medium"],
    4: ["4", "4 - standard", "4-standard", "p4", "standard", "low"],
}
URGENCY_SPELLINGS = {
    1: ["1", "1 - high", "1-high", "high"],
    2: ["2", "2 - medium", "2-medium", "medium"],
    3: ["3", "3 - low", "3-low", "low"],
}
PRIORITY_LABELS = {1: "P1-Critical", 2: "P2-High", 3: "P3-Moderate", 4: "P4-Standard"}
URGENCY_LABELS = {1: "1-High", 2: "2-Medium", 3: "3-Low"}
PRIORITY_TEXT = {1: "1 - Critical", 2: "2 - High", 3: "3 - Moderate", 4: "4 - Standard"}
URGENCY_TEXT = {1: "1 - High", 2: "2 - Medium", 3: "3 - Low"}
STATES = ["Open", "In Progress", "On Hold", "Resolved", "Closed"]
ACTIVE_STATES = ["Open", "In Progress", "On Hold"]
DONE_STATES = ["Resolved", "Closed"]
STATE_ALIASES = {
    "new": "Open", "work in progress": "In Progress", "wip": "In Progress",
    "hold": "On Hold", "pending": "On Hold", "close": "Closed",
    "complete": "Resolved", "completed": "Resolved", "done": "Resolved",
}
SLA_TRUE = ["TRUE", "YES", "1", "Y"]
SLA_FALSE = ["FALSE", "NO", "0", "N"]
EXPORT_DATE = "dd-MM-yyyy HH:mm"
# End of fixed values.

# Three words or numbers with -, /, . or blanks between them, then anything.
_DATE_WORDS = r"^(\w{1,9})[-/.\s]+(\w{1,9})[-/.,\s]+(\w{1,4})(?=$|[T\s])[T\s]*"
# Year first is always year-month-day; then day first, month names, and month first last.
_DATE_ORDERS = ["yyyy-M-d", "d-M-yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "MMM-d-yyyy", "MMMM-d-yyyy", "M-d-yyyy", "yyyyMMdd"]
_TIMES = ["[ H:mm[:ss][.SSSSSS][.SSS]]", " h:mm[:ss] a"]


def _lookup(c: Column, mapping: dict) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def _spelled(c, spellings: dict[int, list[str]]) -> Column:
    """Known spelling, else the first digit inside the legal range, else null."""
    text = F.lower(F.trim(as_col(c).cast("string")))
    known = _lookup(text, {s: k for k, words in spellings.items() for s in words})
    digit = F.regexp_extract(text, f"[1-{max(spellings)}]", 0)
    return F.coalesce(known, F.nullif(digit, F.lit("")).try_cast("int"))


def parse_priority(c, default: int = 3) -> Column:
    return F.coalesce(_spelled(c, PRIORITY_SPELLINGS), F.lit(default))


def parse_urgency(c, default: int = 3) -> Column:
    return F.coalesce(_spelled(c, URGENCY_SPELLINGS), F.lit(default))


def priority_is_known(c) -> Column:
    return _spelled(c, PRIORITY_SPELLINGS).isNotNull()


def urgency_is_known(c) -> Column:
    return _spelled(c, URGENCY_SPELLINGS).isNotNull()


def priority_to_label(c) -> Column:
    """Canonical text of a raw priority; here an unknown value counts as 4."""
    return _lookup(parse_priority(c, default=4), PRIORITY_TEXT)


def urgency_to_label(c) -> Column:
    return _lookup(parse_urgency(c), URGENCY_TEXT)


def priority_short_label(c) -> Column:
    return _lookup(as_col(c), PRIORITY_LABELS)


def urgency_short_label(c) -> Column:
    return _lookup(as_col(c), URGENCY_LABELS)


def parse_sla(c) -> Column:
    return F.coalesce(F.upper(F.trim(as_col(c).cast("string"))).isin(SLA_TRUE), F.lit(False))


def sla_is_known(c) -> Column:
    return F.coalesce(F.upper(F.trim(as_col(c).cast("string"))).isin(SLA_TRUE + SLA_FALSE),
                      F.lit(False))


def normalize_state(c) -> Column:
    text = F.trim(as_col(c).cast("string"))
    return F.coalesce(F.when(text.isin(STATES), text),
                      _lookup(F.lower(text), STATE_ALIASES), F.lit("Open"))


def parse_date(c) -> Column:
    """Timestamp of an export date in any of the accepted spellings, else null.

    Day, month and year with -, /, . or blanks between them, one or two digits, month names,
    eight digits without marks; a time with or without seconds, 24 hours or AM/PM. Ambiguous
    dates are day-first; what only makes sense month-first is read so.
    """
    text = F.trim(as_col(c).cast("string"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, _DATE_WORDS, "$1-$2-$3 "), r"(?i)\s*([ap]m)$", " $1"))
    afternoon = plain.rlike(r"(?i) [ap]m$")

    # A try that fails costs far more than one that is not made: no order reads a blank, a year has four digits at least.
    year_first = plain.rlike(r"^[+-]?\d{4}")

    def read(times: str) -> Column:
        tried = [F.try_to_timestamp(plain, F.lit(f"{d}{times}")) for d in _DATE_ORDERS]
        return F.coalesce(*[F.when(year_first, t) if d.startswith("yyyy") else t for d, t in zip(_DATE_ORDERS, tried)])

    return F.when(text != "", F.coalesce(F.when(afternoon, read(_TIMES[1])).otherwise(read(_TIMES[0])),
                                         F.when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp"))))


def format_date(c) -> Column:
    return F.coalesce(F.date_format(as_col(c), EXPORT_DATE), F.lit(""))


def to_number(c, floor_zero: bool = False) -> Column:
    n = F.coalesce(clean_number(c), F.lit(0.0))
    return F.greatest(n, F.lit(0.0)) if floor_zero else n


def clean_number(c) -> Column:
    n = F.trim(as_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(n), n)


def clamp_numeric(c) -> Column:
    return to_number(c, floor_zero=True)


def agent_name(c) -> Column:
    """The part before " (" of "Name (id)", else the whole value."""
    name = F.regexp_extract(as_col(c), r"^(.*?)\s*\(", 1)
    return F.when(as_col(c).rlike(r"^(.*?)\s*\("), name).otherwise(as_col(c))


def week_label(c) -> Column:
    monday = F.date_trunc("week", as_col(c))
    return F.concat_ws("/", F.date_format(monday, "yyyy-MM-dd"),
                       F.date_format(monday + F.expr("INTERVAL 6 DAYS"), "yyyy-MM-dd"))


def derive_time_parts(df: DataFrame, c: str = "created") -> DataFrame:
    """month, week, date, hour and day name of the created time; null stays null."""
    t = F.col(c)
    return df.withColumns({
        "month": F.date_format(t, "yyyy-MM"),
        "week": F.when(t.isNotNull(), week_label(t)),
        "date": F.date_format(t, "yyyy-MM-dd"),
        "hour": F.coalesce(F.hour(t), F.lit(9)),
        "dow": F.date_format(t, "EEEE"),
    })


def hours_between(start, end) -> Column:
    seconds = F.timestamp_diff("SECOND", as_col(start), as_col(end))
    return seconds.cast("double") / F.lit(3600.0)


def derive_mttr(df: DataFrame) -> DataFrame:
    """Hours from created to resolved; null unless both are there, may be negative."""
    return df.withColumn("mttr_hours", hours_between("created", "resolved"))


def normal_header(name: str) -> str:
    """Header as a column name: trimmed, lower case, blanks/-// to _, rest dropped."""
    return re.sub(r"[^\w]", "", re.sub(r"[\s\-/]+", "_", name.strip().lower()))


def import_header(name: str) -> str:
    """The data-import variant: every other character becomes _, nothing is trimmed."""
    return re.sub(r"[^a-z0-9_]", "_", name.lower())
