"""ISO 8601 instants in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def instant(text: Column) -> Column:
    """The timestamp of an ISO date or time, with a zone or in the session's; null if it is none.

    A date is its midnight; Z, +hh, +hhmm and +hh:mm are zones; fractions beyond microseconds are cut.
    """
    whole = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(whole, ",", "."), r"(\.\d{6})\d+", "$1")
    plain = F.regexp_replace(plain, r"([ T]\d{2})(Z|[+-]\d{2}(?::?\d{2})?)?$", "$1:00$2")
    plain = F.regexp_replace(plain, r"([ T]\d{2}:\d{2})(Z|[+-]\d{2}(?::?\d{2})?)?$", "$1:00$2")
    plain = F.regexp_replace(plain, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    plain = F.regexp_replace(plain, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(whole.rlike(ISO), F.try_to_timestamp(plain))
