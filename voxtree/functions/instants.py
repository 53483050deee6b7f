"""Points in time written in many ways, as microseconds since 1970 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^(\d{4})-?(\d\d)-?(\d\d)[Tt ](\d\d):?(\d\d):?(\d\d)((?:[.,]\d{1,9})?)\s*(|[Zz]|UTC|GMT|[+-]\d\d(?::?\d\d)?)$"
_MAIL = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4})\s+(\d\d:\d\d:\d\d)\s*(|[Zz]|UTC|GMT|UT|[+-]\d\d:?\d\d)$"
# English month names, three letters each, in order.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _zone(text: Column) -> Column:
    """'', Z, GMT → +00:00; +0530, +05 → +05:30, +05:00."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(digits == "", F.lit("+00:00")).otherwise(
        F.concat(F.substring(text, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0"))
    )


def instant_micros(text: Column) -> Column:
    """Microseconds of an instant given as ISO 8601 (extended or basic, any offset), a mail date or
    epoch seconds, milliseconds or microseconds; without a zone it is UTC. Null where unreadable."""
    t = F.trim(F.regexp_replace(text, r"[\t\r\n]", " "))
    iso = F.concat(
        F.regexp_replace(F.regexp_replace(t, _ISO, "$1-$2-$3T$4:$5:$6$7"), ",", "."), _zone(F.regexp_extract(t, _ISO, 8))
    )
    month = (F.instr(F.lit(_MONTHS), F.lower(F.regexp_extract(t, _MAIL, 2))) + 2) / 3
    mail = F.concat(
        F.regexp_extract(t, _MAIL, 3), F.lit("-"), F.lpad(month.cast("int").cast("string"), 2, "0"), F.lit("-"),
        F.lpad(F.regexp_extract(t, _MAIL, 1), 2, "0"), F.lit("T"), F.regexp_extract(t, _MAIL, 4), _zone(F.regexp_extract(t, _MAIL, 5)),
    )
    number = t.try_cast("decimal(20,6)")
    scale = F.when(F.abs(number) < F.lit(10**11), F.lit(10**6)).when(F.abs(number) < F.lit(10**14), F.lit(10**3)).otherwise(F.lit(1))
    return (
        F.when(t.rlike(_ISO), F.unix_micros(iso.try_cast("timestamp")))
        .when(t.rlike(r"^\d{9,17}(\.\d+)?$"), (number * scale).cast("bigint"))
        .when(t.rlike(_MAIL), F.unix_micros(mail.try_cast("timestamp")))
    )


def status_name(text: Column) -> Column:
    """A state without letter case and outer blanks; empty is null."""
    t = F.lower(F.trim(F.regexp_replace(text, r"[\t\r\n]", " ")))
    return F.when(t != "", t)
