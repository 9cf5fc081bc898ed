"""Date parsing and calendar cohorts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts, in the order they are tried.
_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]$", "M/d/yyyy h:m:s a"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
)
# Fixed value: label of the cohort without a readable day.
UNKNOWN_LABEL = "未知日期"
_EXPORT_LAYOUTS = (_LAYOUTS[0], _LAYOUTS[1], _LAYOUTS[3])


def _parse(text: Column, layouts) -> Column:
    return F.coalesce(*[F.when(text.rlike(guard), F.try_to_date(text, layout)) for guard, layout in layouts])


def _head(col: Column) -> Column:
    return F.split_part(F.trim(col), F.lit("T"), F.lit(1))


def parse_date(col: Column) -> Column:
    """Typed date of a text in any accepted layout, NULL when none fits."""
    return _parse(_head(col), _LAYOUTS)


def date_only(col: Column) -> Column:
    """ISO text of the date; text in no known layout passes up to its first space."""
    head = _head(col)
    return F.when(
        F.length(col) > 0,
        F.coalesce(_parse(head, _LAYOUTS).cast("string"), F.split_part(head, F.lit(" "), F.lit(1))),
    )


def export_date(col: Column) -> Column:
    """Date used by the export window: only the first ten characters of the date part count."""
    head = F.split_part(F.split_part(F.trim(col), F.lit("T"), F.lit(1)), F.lit(" "), F.lit(1))
    return _parse(F.left(head, F.lit(10)), _EXPORT_LAYOUTS)


def first_seen_day(col: Column) -> Column:
    """Leading ten characters of a first-seen value, '' when missing."""
    return F.left(F.coalesce(col.cast("string"), F.lit("")), F.lit(10))


def iso_week(first_seen: Column) -> Column:
    """STRUCT(key, monday, label) of the ISO week; unreadable days go to ``unknown``."""
    text = first_seen_day(first_seen)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    monday = F.trunc(day, "week")
    sunday = F.date_add(monday, 6)

    def short(d: Column) -> Column:
        return F.concat(F.month(d).cast("string"), F.lit("/"), F.dayofmonth(d).cast("string"))

    key = F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )
    return F.struct(
        F.coalesce(key, F.lit("unknown")).alias("key"),
        F.coalesce(monday.cast("string"), F.lit("")).alias("monday"),
        F.coalesce(F.concat(short(monday), F.lit("–"), short(sunday)), F.lit(UNKNOWN_LABEL)).alias("label"),
    )


def is_new(first_seen: Column, today: str, window_days: int = 7) -> Column:
    """First seen within the last ``window_days`` of ``today``, bounds included."""
    day = first_seen_day(first_seen)
    since = F.date_sub(F.lit(today).cast("date"), window_days).cast("string")
    return (F.length(day) > 0) & (day >= since)


def epoch_ms_day(col: Column) -> Column:
    """ISO day of an epoch-milliseconds number given as text; other text is kept."""
    millis = F.when(col.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), col.try_cast("double").cast("bigint"))
    days = F.floor(millis / 86_400_000).cast("int")
    return F.coalesce(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), col)


def us_date(col: Column) -> Column:
    """``MM/dd/yyyy`` of an ISO date or timestamp; other text is kept."""
    head = F.split_part(col, F.lit("T"), F.lit(1))
    day = F.when(head.rlike(_LAYOUTS[0][0]), F.try_to_date(head, "yyyy-M-d"))
    return F.coalesce(F.date_format(day, "MM/dd/yyyy"), col)


def fetch_since(
    explicit: Column, watermark: Column, today: Column, requested_days: Column, max_lookback_days: int | None = None
) -> Column:
    """Start of the fetch window: explicit, else watermark, else the look-back.

    ``max_lookback_days`` limits the look-back and how old a watermark may be, never an explicit start.
    """
    mark = null_if_blank(watermark)
    if max_lookback_days is not None:
        floor = F.date_sub(today, max_lookback_days).cast("string")
        mark = F.when(mark.isNotNull(), F.greatest(mark, floor))
        requested_days = F.least(requested_days, F.lit(max_lookback_days))
    return F.coalesce(null_if_blank(explicit), mark, F.date_sub(today, requested_days).cast("string"))


def null_if_blank(col: Column) -> Column:
    return F.nullif(col.cast("string"), F.lit(""))


def is_recent(value: Column, since: Column) -> Column:
    """Not before ``since``; a missing or unreadable date on either side is kept."""
    day, start = parse_date(value), parse_date(since)
    return day.isNull() | start.isNull() | (day >= start)
