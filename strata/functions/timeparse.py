"""Text to instant, over the layouts a file's modification time is written in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"


def parse_instant(text: Column) -> Column:
    """The instant named by ``text``; null for null, blank or unreadable text. No zone means UTC.

    Read are RFC 3339 with or without fraction and offset, 'date time +hhmm ZONE', and the three layouts that begin
    with the day of the week (with no zone, a zone name before the year, or an offset before the year).
    """
    t = F.trim(text)
    # 2024-07-19 10:00:45.239022 +0000 UTC -> 2024-07-19T10:00:45.239022+00:00; anything after the offset names the zone again
    iso = F.regexp_replace(t, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d{1,6})?\d*\s*(Z|[+-]\d\d:?\d\d)?(?:\s+[A-Za-z+\-\d]+)?(?:\s+m=.*)?$", "$1T$2$3$4")
    iso = F.regexp_replace(iso, r"([+-]\d\d)(\d\d)$", "$1:$2")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?)$", "$1Z")
    day = F.regexp_replace(F.regexp_replace(t, _DAY, ""), r"\s+", " ")
    # Jan 2 15:04:05 [UTC|-0700] 2006 -> 2 Jan 2006 15:04:05 -0700
    moved = F.regexp_replace(day, r"^([A-Za-z]{3}) (\d{1,2}) (\d\d:\d\d:\d\d)(?: (?:UTC|GMT|Z))? (\d{4})$", "$2 $1 $4 $3 +0000")
    moved = F.regexp_replace(moved, r"^([A-Za-z]{3}) (\d{1,2}) (\d\d:\d\d:\d\d) ([+-]\d{4}) (\d{4})$", "$2 $1 $5 $3 $4")
    named = F.when(moved.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$"), F.try_to_timestamp(moved, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d\d-\d\d"), iso.try_cast("timestamp")), named)
