"""Dates as feeds write them (N4): a small grammar instead of a list of forms.

A string is cut into a time of day with its zone, names and numbers. Names are months, week
days, zones or fillers; any other word makes the string unreadable. The numbers left over are
year, month and day by the place of the month's name, by how many digits they have and by what
fits: a number over 31 or of three digits and more is a year, a first number over 12 is a
day, otherwise the month comes first (3/4/2024 is 4 March).

What a string leaves out comes from ``default`` (the day cut to the month's last); without a
default such strings are unreadable. Two-digit years below ``CENTURY_TURN`` are of this
century. A numeric offset is applied; zone names without one mean UTC. Unreadable strings and
dates that don't exist are null. Every step binds what it computed to a lambda's argument, so
nothing is evaluated twice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

CENTURY_TURN = 74
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = (r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
_DAY = r"(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:s|nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
_ZONE = r"(?:z|utc|ut|gmt|[ecmp][sd]t|bst|wes?t|cest|cet|ees?t|msk|ist|jst|kst|aes?t|aedt|nzd?t)"
_FILL = r"(?:st|nd|rd|th|of|at|on|and|the|t|m|ad)"
_OFFSET = r"[+-][0-9]{1,2}:?[0-9]{2}|[+-][0-9]{2}"
# hour, minute, second, fraction, half of the day, offset; a zone's name is any short word that
# is no month or week day
_TIME = (r"(?<![0-9:])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,6})[0-9]*)?)?\s*([ap]\.?m\b\.?)?"
         rf"\s*(?:(?!(?:{_MONTH}|{_DAY}|{_FILL})\b)[a-z]{{1,5}}\b)?\s*({_OFFSET})?(?![0-9:])")
_HOUR = r"(?<![0-9:.])([0-9]{1,2})\s*([ap]\.?m\b\.?)"
_COMPACT = r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?:t?([0-9]{2}):?([0-9]{2})(?::?([0-9]{2})(?:\.[0-9]+)?)?)?(?![0-9])"
_BARE_ZONE = rf"\A([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})\s*({_OFFSET}|z)\z"
_REST = r"\A[a-z0-9\s,;./'-]*\z"
_WORDS = rf"\A(?:{_MONTH}|{_DAY}|{_ZONE}|{_FILL})\z"


def _bind(column: Column, step) -> Column:
    """``step`` of a column that is computed once."""
    return F.get(F.transform(F.array(column), step), 0)


def _number(x: Column) -> Column:
    return x.cast("int")


def _split(s: Column) -> Column:
    """Time of day and the rest of a lower-cased string."""
    clock, hour = s.rlike(_TIME), s.rlike(_HOUR)
    part = lambda i: F.when(clock, F.regexp_extract(s, _TIME, i))
    return F.struct(
        (clock | hour).alias("timed"),
        F.coalesce(part(1), F.when(hour, F.regexp_extract(s, _HOUR, 1)), F.lit("0")).alias("hour"),
        F.coalesce(part(2), F.lit("0")).alias("minute"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0")).alias("second"),
        F.coalesce(part(4), F.lit("")).alias("fraction"),
        F.left(F.coalesce(part(5), F.when(hour, F.regexp_extract(s, _HOUR, 2)), F.lit("")), F.lit(1)).alias("half"),
        F.coalesce(part(6), F.lit("")).alias("offset"),
        F.when(clock, F.regexp_replace(s, _TIME, " ")).when(hour, F.regexp_replace(s, _HOUR, " ")).otherwise(s).alias("rest"))


def _read(p: Column) -> Column:
    """The parts, with the numbers and the month's name in order (``seq``; the name as ``#n``);
    null where a word or character has no place in a date."""
    words = F.regexp_extract_all(p["rest"], F.lit(r"([0-9]+|[a-z]+)"), F.lit(1))
    month = lambda w: F.concat(F.lit("#"), (F.floor((F.call_function("locate", F.left(w, F.lit(3)), F.lit("".join(MONTHS))) + 2) / 3)).cast("string"))
    seq = F.transform(F.filter(words, lambda w: w.rlike(rf"\A(?:[0-9]+|{_MONTH})\z")), lambda w: F.when(w.rlike("[a-z]"), month(w)).otherwise(w))
    known = F.forall(words, lambda w: w.rlike("[0-9]") | w.rlike(_WORDS))
    return F.when(p["rest"].rlike(_REST) & known, F.struct(p.alias("p"), seq.alias("seq")))


def _resolve(x: Column) -> Column:
    """year, month, day as strings (null: left out), null where the numbers don't fit."""
    q, n = x["seq"], F.size(x["seq"])
    t = [F.get(q, i) for i in range(3)]
    named = [F.coalesce(v.startswith("#"), F.lit(False)) for v in t]
    year = [(_number(v) > 31) | (F.length(v) > 2) for v in t]
    name = lambda i: F.substring(t[i], 2, 2)
    none = F.lit(None).cast("string")

    def ymd(y, m, d):
        return F.struct(F.coalesce(y, none).alias("year"), F.coalesce(m, none).alias("month"), F.coalesce(d, none).alias("day"))
    three = (F.when(named[0], F.when(year[1], ymd(t[1], name(0), t[2])).otherwise(ymd(t[2], name(0), t[1])))
             .when(named[1], F.when(year[0], ymd(t[0], name(1), t[2])).otherwise(ymd(t[2], name(1), t[0])))
             .when(named[2], F.when(year[1], ymd(t[1], name(2), t[0])).otherwise(ymd(t[0], name(2), t[1])))
             .when(year[0], ymd(t[0], t[1], t[2])).when(_number(t[0]) > 12, ymd(t[2], t[1], t[0])).otherwise(ymd(t[2], t[0], t[1])))
    two = (F.when(named[0], F.when(year[1], ymd(t[1], name(0), none)).otherwise(ymd(none, name(0), t[1])))
           .when(named[1], F.when(year[0], ymd(t[0], name(1), none)).otherwise(ymd(none, name(1), t[0])))
           .when(year[0], ymd(t[0], t[1], none)).when(year[1], ymd(t[1], t[0], none)).otherwise(ymd(none, t[0], t[1])))
    one = (F.when(named[0], ymd(none, name(0), none)).when(year[0], ymd(t[0], none, none)).otherwise(ymd(none, none, t[0])))
    names = F.size(F.filter(q, lambda v: v.startswith("#")))
    date = F.when(names <= 1, F.when(n == 3, three).when(n == 2, two).when(n == 1, one).when((n == 0) & x["p"]["timed"], ymd(none, none, none)))
    return F.when(date.isNotNull(), F.struct(x["p"].alias("p"), date.alias("d")))


def _iso(x: Column, default: datetime | None) -> Column:
    p, d = x["p"], x["d"]
    two = lambda v: F.lpad(v, 2, "0")
    y, m, day = d["year"], d["month"], d["day"]
    y = F.when(F.length(y) <= 2, F.when(_number(y) < CENTURY_TURN, F.concat(F.lit("20"), two(y))).otherwise(F.concat(F.lit("19"), y))).when(F.length(y) == 4, y)
    if default is not None:
        y = F.when(d["year"].isNull(), F.lit(f"{default.year:04d}")).otherwise(y)
        m = F.coalesce(m, F.lit(str(default.month)))
        last = F.dayofmonth(F.last_day(F.concat(y, F.lit("-"), two(m), F.lit("-01")).try_cast("date")))
        day = F.coalesce(day, F.least(F.lit(default.day), last).cast("string"))
    hour = _number(p["hour"])
    hour = (F.when(p["half"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(p["half"] == "p", 12).otherwise(0)))
    off = F.regexp_extract(p["offset"], r"\A([+-])([0-9]{1,2}):?([0-9]{2})?\z", 1)
    zone = F.when(off == "", F.lit("+00:00")).otherwise(F.concat(
        off, two(F.regexp_extract(p["offset"], r"\A[+-]([0-9]{1,2}?):?([0-9]{2})?\z", 1)), F.lit(":"),
        F.lpad(F.regexp_extract(p["offset"], r"\A[+-][0-9]{1,2}?:?([0-9]{2})?\z", 1), 2, "0")))
    fits = (F.length(m) <= 2) & (F.length(day) <= 2)
    fraction = F.when(p["fraction"] != "", F.concat(F.lit("."), p["fraction"])).otherwise(F.lit(""))
    return F.when(fits, F.concat(y, F.lit("-"), two(m), F.lit("-"), two(day), F.lit("T"), two(hour.cast("string")), F.lit(":"), two(p["minute"]),
                                 F.lit(":"), two(p["second"]), fraction, zone))


def parse_date(c, default: datetime | None = None) -> Column:
    """One date string -> UTC timestamp or null."""
    s = F.lower(strip_ws(F.col(c) if isinstance(c, str) else c))
    s = F.regexp_replace(F.regexp_replace(s, _BARE_ZONE, "$1 00:00 $2"), _COMPACT, "$1-$2-$3 $4:$5:$6")
    s = F.regexp_replace(F.regexp_replace(s, r" ::", " "), r"(:[0-9]{2}):(?![0-9])", "$1")
    s = F.when(s != "", s)
    return _bind(_bind(_bind(_bind(s, _split), _read), _resolve), lambda x: _iso(x, default)).try_cast("timestamp")
