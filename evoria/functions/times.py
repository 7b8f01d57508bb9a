"""Times with precision, half-open ranges, decay."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried, with the precision they give.
FORMATS = (("yyyy-MM-dd'T'HH:mm:ssXXX", "second"), ("yyyy-MM-dd HH:mm:ss", "second"), ("yyyy-MM-dd HH:mm", "minute"), ("yyyy-MM-dd'T'HH:mm:ss", "second"), ("yyyy-M-d", "day"), ("yyyy.M.d", "day"), ("yyyy年M月d日", "day"), ("yyyy/M/d", "day"), ("yyyy年M月", "month"), ("yyyy-M", "month"), ("yyyy年", "year"), ("yyyy", "year"))


#: The formats of the lenient ISO form.
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d", "yyyy.M.d", "yyyy/M/d", "yyyy年M月d日")
#: Wall-clock times are those of this zone; strings without a zone are taken to be in it.
ZONE_SECONDS = 8 * 3600
#: What is dropped from a string, and the dates that are looked for inside it.
BRACKETED = r"（[^）]*）|\([^)]*\)"
DAY_INSIDE = r"(\d{4})[-年./](\d{1,2})[-月./](\d{1,2})[日]?"
MONTH_INSIDE = r"(\d{4})[-年](\d{1,2})"
YEAR_INSIDE = r"(19|20)\d{2}"
#: Years that event times may have.
EVENT_YEARS = (2015, 2027)


def _wall(seconds: Column) -> Column:
    """The wall-clock time that is so many seconds after the start of 1970, in no zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def _shape(fmt: str) -> str:
    """The pattern of the strings that ``fmt`` reads: exact widths, but one or two digits for M and d alone."""
    fields = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}", "XXX": r"[+-]\d{2}:?\d{2}", "'T'": "T", ".": r"\."}
    return "^" + "".join(fields.get(m[0], m[0]) for m in re.finditer(r"'T'|([A-Za-z])\1*|.", fmt)) + "$"


def _read(value: Column, fmt: str) -> Column:
    """Wall-clock time in +08:00 of a string of the format, null where it names no time."""
    zoned = fmt.endswith("XXX")
    at = F.try_to_timestamp(F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2") if zoned else F.concat(value, F.lit(" +00:00")), F.lit(fmt if zoned else fmt + " XXX"))
    return F.when(value.rlike(_shape(fmt)), _wall(F.unix_micros(at) / F.lit(1_000_000) + F.lit(ZONE_SECONDS if zoned else 0)))


def parse_time(text: Column) -> Column:
    """struct(at, precision) of the first format that fits, else of the first date, month or year inside the text.

    ``at`` is the wall-clock time in +08:00, of a type without zone, so that months and days do not depend on the session.
    A plain number of nine digits or more (as JSON numbers arrive) is seconds since 1970. Null where nothing is found.
    """
    plain = F.trim(text)
    s = F.trim(F.regexp_replace(F.replace(plain, F.lit("Z"), F.lit("+00:00")), BRACKETED, ""))
    made = lambda at, precision: F.struct(at.alias("at"), F.lit(precision).alias("precision"))

    def inside(pattern: str, groups: int) -> Column:
        parts = [F.regexp_extract(s, pattern, i + 1) for i in range(groups)] if groups > 1 else [F.regexp_extract(s, pattern, 0)]
        return _read(F.concat_ws("-", *parts, *([F.lit("1")] * (3 - len(parts)))), "yyyy-M-d")

    # every attempt stands once in an array, so the expression stays small
    epoch = F.when(plain.rlike(r"^-?\d{9,11}(\.\d+)?$"), _wall(plain.try_cast("decimal(18,6)") + F.lit(ZONE_SECONDS)))
    tries = [made(epoch, "second"), *(made(_read(s, f), p) for f, p in FORMATS)]
    tries += [made(inside(DAY_INSIDE, 3), "day"), made(inside(MONTH_INSIDE, 2), "month"), made(inside(YEAR_INSIDE, 1), "year")]
    return F.get(F.filter(F.array(*tries), lambda x: x["at"].isNotNull()), F.lit(0))


def lenient_iso(text: Column) -> Column:
    """ISO string to the second with the offset that was given, +08:00 where none was; null if no format fits."""
    s = F.replace(F.trim(text), F.lit("Z"), F.lit("+00:00"))
    iso = lambda at: F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("+08:00"))
    zoned = F.when(_read(s, ISO_FORMATS[0]).isNotNull(), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    return F.coalesce(zoned, *(iso(_read(s, f)) for f in ISO_FORMATS[1:]))


def time_range(at: Column, precision: Column) -> Column:
    """Half-open struct(lower, upper): the second, minute, hour, day, month or year that starts at ``at`` (else a day)."""
    span = lambda **k: at + F.make_dt_interval(**{n: F.lit(v) for n, v in k.items()})
    upper = F.when(precision == "second", span(secs=1)).when(precision == "minute", span(mins=1)).when(precision == "hour", span(hours=1)).when(precision == "month", at + F.expr("INTERVAL 1 MONTH")).when(precision == "year", at + F.expr("INTERVAL 1 YEAR")).otherwise(span(days=1))
    return F.struct(at.alias("lower"), upper.alias("upper"))


def clamp_year(at: Column, least: int, most: int) -> Column:
    return F.when(F.year(at).between(least, most), at)


def event_time(lower: Column, upper: Column, point: Column, precision: Column) -> Column:
    """struct(lower, upper, precision) from text bounds: reversed bounds are swapped, half-known ranges stay open.

    A bound or point outside ``EVENT_YEARS`` counts as unknown. A bound that is known keeps its precision.
    """
    clamped = lambda t: F.when(F.year(t["at"]).between(*EVENT_YEARS), t)
    bounds = F.array(F.struct(parse_time(lower).alias("lo"), parse_time(upper).alias("hi"), parse_time(point).alias("pt"), F.when(precision != "unknown", precision).alias("given")))
    unknown = F.lit(None).cast("timestamp_ntz")
    made = lambda lo, hi, p: F.struct(lo.alias("lower"), hi.alias("upper"), p.alias("precision"))

    def one(x: Column) -> Column:
        said_lo, said_hi, given = x["lo"], x["hi"], x["given"]
        lo, hi, pt = clamped(said_lo), clamped(said_hi), clamped(x["pt"])
        end = lambda t: time_range(t["at"], t["precision"])["upper"]
        both = made(F.least(lo["at"], hi["at"]), F.greatest(lo["at"], hi["at"]), F.coalesce(given, lo["precision"], F.lit("day")))
        only_lo = made(lo["at"], unknown, F.coalesce(given, lo["precision"]))
        # an upper bound beside one that was dropped stays as it is; alone, it is the end of what it names
        only_hi = made(unknown, F.when(said_lo.isNull(), end(hi)).otherwise(hi["at"]), F.coalesce(given, hi["precision"]))
        of_point = made(pt["at"], end(pt), pt["precision"])
        named = said_lo.isNotNull() | said_hi.isNotNull()
        return F.when(lo.isNotNull() & hi.isNotNull(), both).when(lo.isNotNull(), only_lo).when(hi.isNotNull(), only_hi).when(~named & pt.isNotNull(), of_point).otherwise(made(unknown, unknown, F.lit("unknown")))

    return F.get(F.transform(bounds, one), F.lit(0))


def day_gap(lower_a: Column, upper_a: Column, lower_b: Column, upper_b: Column) -> Column:
    """Whole days between two closed intervals, 0 where they meet, null where a bound is unknown."""
    after = F.timestamp_diff("DAY", upper_a, lower_b)
    before = F.timestamp_diff("DAY", upper_b, lower_a)
    known = lower_a.isNotNull() & upper_a.isNotNull() & lower_b.isNotNull() & upper_b.isNotNull()
    return F.when(known, F.when(lower_b > upper_a, after).when(lower_a > upper_b, before).otherwise(0))


def decay(at: Column, window_from: Column, window_to: Column, tau_days: float = 180.0) -> Column:
    """1 inside the window or without one, 0.6 where the time is unknown, else exp(-days / tau); days round up below the window."""
    days = F.abs(F.floor((F.unix_micros(window_from) - F.unix_micros(at)) / 86_400_000_000))
    return F.when(window_from.isNull(), F.lit(1.0)).when(at.isNull(), F.lit(0.6)).when((at >= window_from) & (window_to.isNull() | (at <= window_to)), F.lit(1.0)).otherwise(F.exp(-days / tau_days))


#: How a question names a day, a month, and the years or months before now.
QUERY_DAY = r"(\d{4})[-年/](\d{1,2})[-月/](\d{1,2})[日号]?"
QUERY_MONTH = r"(\d{4})[-年](\d{1,2})月?"
LAST_YEARS = "(近|过去)(一|两|三|1|2|3)年"
LAST_MONTHS = "(近|过去)(一|两|三|六|1|2|3|6)个?月"


def query_date(query: Column) -> Column:
    """Noon of the date, or noon of the 15th of the month, that the text names; null if none or no such day."""
    day, month = QUERY_DAY, QUERY_MONTH
    at = lambda p, d: F.try_to_timestamp(F.concat(F.regexp_extract(query, p, 1), F.lit("-"), F.regexp_extract(query, p, 2), F.lit("-"), d, F.lit(" 12")), F.lit("yyyy-M-d HH"))
    return F.when(query.rlike(day), at(day, F.regexp_extract(query, day, 3))).when(query.rlike(month), at(month, F.lit("15")))


def relative_window(query: Column, now: Column) -> Column:
    """Start of the window that "last N years / months" means before ``now`` (days of the month are clamped), else null."""
    digits = {"一": 1, "两": 2, "三": 3, "六": 6, "1": 1, "2": 2, "3": 3, "6": 6}
    years = F.regexp_extract(query, LAST_YEARS, 2)
    months = F.regexp_extract(query, LAST_MONTHS, 2)
    number = lambda c: F.create_map(*(F.lit(x) for kv in digits.items() for x in kv))[c]
    return F.when(years != "", F.add_months(F.to_date(now), -12 * number(years))).when(months != "", F.add_months(F.to_date(now), -number(months)))
