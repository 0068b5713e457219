"""Line scans for leaks, chunked texts, redaction and constraint checks."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HAZARD_RULES, LEAK_RULES, PRIVATE_PATH, SECRET, URL, host


def leak_findings(docs: DataFrame, key: str, text: str, rules: dict[str, str] | None = None, allow: DataFrame | None = None) -> DataFrame:
    """(key, line_no, code) of each rule that a line breaks, but for allowed (key, code) pairs."""
    rules = rules or LEAK_RULES
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    codes = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), n) for n, p in rules.items())))
    found = lines.select(key, (F.col("at") + 1).alias("line_no"), F.explode(codes).alias("code"))
    return found.join(allow.select(key, "code").distinct(), [key, "code"], "left_anti").select(key, "line_no", "code") if allow is not None else found


def redact(text: Column) -> Column:
    """Secrets, addresses and private paths replaced by their kind."""
    out = F.regexp_replace(text, SECRET, "[secret]")
    out = F.regexp_replace(out, URL, "[url]")
    return F.regexp_replace(out, PRIVATE_PATH, " [path]")


def redact_url(url: Column, mode: str = "domain_only") -> Column:
    if mode == "omit":
        return F.lit("[url omitted]")
    return host(url) if mode == "domain_only" else url


def keyed_digest(column: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 in hexadecimal (Arrow batches)."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret, v.encode(), hashlib.sha256).hexdigest())

    return digest(column)


def chunk_texts(docs: DataFrame, key: str, text: str, size: int = 256 << 10, overlap: int = 256) -> DataFrame:
    """(key, chunk_no, byte_start, byte_count, sha256, hazards): UTF-8-safe chunks of at most ``size`` bytes.

    Hazards are looked for in the chunk with ``overlap`` characters of the one before, so none hides at a cut.
    """
    import re

    rules = {n: re.compile(p) for n, p in HAZARD_RULES.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, value in zip(frame[key], frame[text], strict=True):
                raw, at, no, before = (value or "").encode(), 0, 0, ""
                while at < len(raw) or not no:
                    stop = min(at + size, len(raw))
                    while stop < len(raw) and (raw[stop] & 0xC0) == 0x80:
                        stop -= 1
                    part = raw[at:stop]
                    seen = before + part.decode()
                    rows.append((k, no, at, len(part), hashlib.sha256(part).hexdigest(), [n for n, p in rules.items() if p.search(seen)]))
                    at, no, before = stop, no + 1, seen[-overlap:]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "byte_start", "byte_count", "sha256", "hazards"])

    return docs.select(key, text).mapInPandas(run, f"key {docs.schema[key].dataType.simpleString()}, chunk_no int, byte_start long, byte_count long, sha256 string, hazards array<string>").withColumnRenamed("key", key)


def check_rules(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) of each row that breaks a rule: a rule holds where its column is true, and null breaks it."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items())))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("code"))


def check_unique(rows: DataFrame, key: list[str], code: str = "DUPLICATE_KEY") -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("key"), F.lit(code).alias("code"))


def check_references(rows: DataFrame, key: str, column: str, targets: DataFrame, target: str, code: str = "UNKNOWN_REFERENCE") -> DataFrame:
    known = targets.select(F.col(target).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit(code).alias("code"))


def check_append_only(events: DataFrame, event: str, ts: str, by: list[str], code: str = "OUT_OF_ORDER") -> DataFrame:
    """Events that are stamped before the one that was appended just before them (column ``seq``).

    Events of one ``seq`` count as appended in the order of their stamps, then of their keys, however rows lie.
    """
    from pyspark.sql import Window

    before = F.lag(ts).over(Window.partitionBy(*by).orderBy("seq", ts, event))
    return events.withColumn("_before", before).filter(F.col(ts) < F.col("_before")).select(F.col(event).cast("string").alias("key"), F.lit(code).alias("code"))


def rollup(findings: DataFrame, total: DataFrame) -> DataFrame:
    """(inspected, rejected, status) of a check: pass, or fail with any finding."""
    bad = findings.select("key").distinct().agg(F.count("*").alias("rejected"))
    return total.agg(F.count("*").alias("inspected")).crossJoin(bad).withColumn("status", F.when(F.col("rejected") > 0, "fail").otherwise("pass"))  # one row each
