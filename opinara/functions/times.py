"""Times as people and stores write them, read strictly: what is no time is an error, one without a zone is the board's own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "Asia/Taipei"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CLOCK = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?)(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def read_time(text: Column, end_of_day: bool = False, zone: str = ZONE, strict: bool = True) -> Column:
    """The instant; null for null and blank. A day alone (2024-05-01, 2024/05/01, 20240501) is its first microsecond, or its last with ``end_of_day``.

    A time of day needs no seconds; Z and offsets are heeded, else the clock is that of ``zone``. Independent of the session's zone.
    """
    t = F.trim(text)
    day = F.when(t.rlike(DAY), t).when(t.rlike("^[0-9]{8}$"), F.regexp_replace(t, "^(....)(..)(..)$", "$1-$2-$3")).when(t.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.regexp_replace(F.regexp_replace(t, "/", "-"), r"-([0-9])(?![0-9])", "-0$1"))
    part = lambda k: F.regexp_extract(t, CLOCK, k)
    clock = F.rpad(part(2), 5, ":00")
    clock = F.when(F.length(part(2)) == 2, F.concat(part(2), F.lit(":00:00"))).when(F.length(part(2)) == 5, F.concat(clock, F.lit(":00"))).otherwise(part(2))
    offset = F.when(part(3) == "", F.lit(zone)).when(part(3) == "Z", "+00:00").when(part(3).contains(":"), part(3)).otherwise(F.concat(F.substring(part(3), 1, 3), F.lit(":"), F.substring(part(3), 4, 2)))
    whole = F.when(day.isNotNull(), F.concat(day, F.lit(" 23:59:59.999999" if end_of_day else " 00:00:00"), F.lit(f" {zone}"))).when(t.rlike(CLOCK), F.concat(part(1), F.lit(" "), clock, F.lit(" "), offset))
    found = whole.try_cast("timestamp")
    if not strict:
        return found
    bad = (t != "") & found.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("no time: "), t)).cast("timestamp")).otherwise(found)


def stored_time(text: Column, zone: str = ZONE) -> Column:
    """A time that a store must hold: null and blank are errors, too."""
    missing = text.isNull() | (F.trim(text) == "")
    return F.when(missing, F.raise_error(F.lit("no stored time")).cast("timestamp")).otherwise(read_time(text, zone=zone))


def in_zone(at: Column, zone: str = ZONE) -> Column:
    """What the clock of the zone shows, without a zone."""
    micros = F.unix_micros(at)
    shown = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)")))
    return shown
