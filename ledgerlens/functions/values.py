"""Numbers, instants, JSON and keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def instant(text: Column) -> Column:
    """An RFC 3339 text as a timestamp, null where it is none; without an offset it is UTC."""
    return F.try_to_timestamp(text)


def age_days(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000.0)


def backoff(last_failure: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(last_failure.cast("timestamp")) + seconds.cast("long") * 1_000_000)


def year(value: Column) -> Column:
    """A whole year of 1 or more, or the year of an ISO date, else null."""
    text = F.trim(value.cast("string"))
    found = F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d{1,9})$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^(\d{4})-\d{2}(?:-\d{2})?", 1), F.lit("")))
    return F.when(found.cast("int") >= 1, found.cast("int"))


def quantity(payload: Column) -> Column:
    """The first of value, numeric_value and year in a JSON object that is a number."""
    return F.coalesce(*(F.get_json_object(payload, f"$.{k}").try_cast("double") for k in ("value", "numeric_value", "year")))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def bounded_score(value: Column) -> Column:
    return F.round(clamp(value, -100, 100), 4)


def capped(count: Column, cap: int) -> Column:
    return F.least(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)), F.lit(cap))


def confidence(value: Column) -> Column:
    """A finite number from 0 to 1, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & number.between(0.0, 1.0), number)


def confidence_band(value: Column) -> Column:
    out = F.when(confidence(value).isNull(), None)
    for below, name in vocab.CONFIDENCE_BANDS:
        out = out.when(value < below, name)
    return out.otherwise("very_high")


def productivity(leads: Column, captures: Column, works: Column, queries: Column) -> Column:
    return F.round(F.least(F.lit(1.0), (leads + 2 * captures + 4 * works) / F.greatest(F.lit(1), 10 * queries)), 4)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits))


def _one_json(text: Column) -> Column:
    """The text as a one-element variant array: the parser stops after a value, but brackets show what follows it."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else; a key given twice, or NaN, makes it none."""
    parsed = _one_json(text)
    return F.coalesce(parsed.isNotNull() & F.try_variant_get(parsed, "$[0]", "variant").isNotNull() & F.try_variant_get(parsed, "$[1]", "variant").isNull(), F.lit(False))


def json_text(payload: Column, field: str) -> Column:
    """A field of a JSON object, null if the text is no valid JSON."""
    return json_number(payload, field, "string")


def json_number(payload: Column, field: str, kind: str = "int") -> Column:
    parsed = _one_json(payload)
    return F.when(F.try_variant_get(parsed, "$[1]", "variant").isNull(), F.try_variant_get(parsed, f"$[0].{field}", kind))


def content_id(prefix: str, *parts: Column, size: int = 24) -> Column:
    """A key from the parts' digest; null parts are empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, size))


def uuid5(namespace: str, name: Column) -> Column:
    """A version 5 UUID, from SHA-1 as RFC 4122 has it."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
