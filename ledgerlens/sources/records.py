"""CSV, JSON, JSON-lines and XML records with locators, and where they fail.

A record's locator counts within its file (row:2, index:0, line:7,
/records[1]/record[2]), which needs whole files: each is read by one task with
``binaryFile`` and parsed in Arrow batches; files of a folder are parsed in
parallel.  Bulk input without locators goes through ``spark.read`` instead.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "path string, locator string, record_kind string, record_json string, error string"
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xml": "xml"}

Row = tuple[str, str, str | None, str | None]


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _kind(value: object) -> str:
    return "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"


def _strict(text: str) -> object:
    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("duplicate key")
        return out

    def constant(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def parse_csv(text: str) -> Iterator[Row]:
    rows = csv.reader(io.StringIO(text), strict=True)
    header = next(rows, None)
    if not header:
        yield "row:0", "object", None, "missing header"
        return
    if len(set(header)) != len(header):
        yield "row:0", "object", None, "duplicate header"
        return
    for n, row in enumerate(rows, 1):
        if len(row) != len(header):
            yield f"row:{n}", "object", None, "extra fields" if len(row) > len(header) else "missing fields"
        else:
            yield f"row:{n}", "object", _dump(dict(zip(header, row, strict=True))), None


def parse_json(text: str, record_path: str = "") -> Iterator[Row]:
    try:
        value = _strict(text)
    except ValueError as e:
        yield "file", "object", None, str(e)
        return
    for part in filter(None, record_path.split(".")):
        if isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            yield "file", "object", None, f"record path not found: {record_path}"
            return
    if isinstance(value, list):
        for n, item in enumerate(value):
            yield f"index:{n}", _kind(item), _dump(item), None
    else:
        yield "object:1", _kind(value), _dump(value), None


def parse_jsonl(text: str) -> Iterator[Row]:
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip():
            try:
                value = _strict(line)
            except json.JSONDecodeError as e:
                yield f"line:{n}", "object", None, f"line {n} column {e.colno}: {e.msg}"
            except ValueError as e:
                yield f"line:{n}", "object", None, f"line {n}: {e}"
            else:
                yield f"line:{n}", _kind(value), _dump(value), None


def parse_xml(text: str, record_path: str = "") -> Iterator[Row]:
    from xml.etree import ElementTree

    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        yield "file", "object", None, "document types are refused"
        return
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        yield "file", "object", None, str(e)
        return
    place: dict[int, str] = {id(root): f"/{root.tag}[1]"}
    for parent in root.iter():
        seen: dict[str, int] = {}
        for child in parent:
            seen[child.tag] = seen.get(child.tag, 0) + 1
            place[id(child)] = f"{place[id(parent)]}/{child.tag}[{seen[child.tag]}]"
    chosen = root.findall(record_path) if record_path else list(root) or [root]
    for element in chosen:
        fields = {f"@{k}": v for k, v in element.attrib.items()}
        for child in element:
            fields.setdefault(child.tag, (child.text or "").strip())
        if not len(element) and (element.text or "").strip():
            fields["#text"] = (element.text or "").strip()
        yield place[id(element)], "object", _dump(fields), None


PARSERS = {"csv": lambda t, p: parse_csv(t), "json": parse_json, "jsonl": lambda t, p: parse_jsonl(t), "xml": parse_xml}


def read_records(spark: SparkSession, path: str, structured_format: str | None = None, record_path: str = "", glob: str | None = None) -> DataFrame:
    """(path, locator, record_kind, record_json, error) of every record of the files at ``path``.

    The format is given or taken from each file's suffix; a file of another suffix is one row with an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                kind = structured_format or FORMATS.get(name[name.rfind(".") :].lower() if "." in name else "")
                rows: list[Row] = []
                if kind not in PARSERS:
                    rows = [("file", "object", None, "unsupported format")]
                else:
                    try:
                        rows = list(PARSERS[kind](content.decode("utf-8-sig"), record_path))
                    except UnicodeDecodeError:
                        rows = [("file", "object", None, "not UTF-8")]
                    except csv.Error as e:
                        rows = [("file", "object", None, str(e))]
                yield pd.DataFrame([(name, *r) for r in rows], columns=["path", "locator", "record_kind", "record_json", "error"])

    return files.mapInPandas(run, RECORDS)


def quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows)."""
    return records.filter("error IS NULL").drop("error"), records.filter("error IS NOT NULL")


def classify_payloads(files: DataFrame, most: int = 64 << 10) -> DataFrame:
    """(path, byte_count, sha256, encoding, status): binary, not UTF-8, mostly unprintable, oversized or text."""
    content, size = F.col("content"), F.octet_length("content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    head = F.substring(text, 1, 4096)
    printable = F.length(F.regexp_replace(head, r"[^\x09\x0A\x0D\x20-\x7E -￿]", "")) / F.greatest(F.length(head), F.lit(1))
    status = F.when(F.position(F.lit("00"), F.hex(F.substring(content, 1, 4096))) % 2 == 1, "binary").when(text.isNull(), "bad_utf8").when(printable < 0.75, "unprintable").when(size > most, "oversized").otherwise("text")
    return files.select("path", size.cast("long").alias("byte_count"), F.sha2(content, 256).alias("sha256"), F.when(text.isNotNull(), "utf-8").otherwise("binary").alias("encoding"), status.alias("status"))
