"""Labels, identifiers, snippets, profiles and pattern scans as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

#: Patterns of the leak and hazard contract.
SECRET = r"(?i)(authorization:\s*bearer|api[_-]?key\s*=|secret\s*=|token\s*=|private key)"
PRIVATE_PATH = r"""(?i)(?:^|[\s'"(])(?:/home/|/Users/|/tmp/|file://|~/|[A-Za-z]:\\\\)[^\s'"()]+"""
LEAK_RULES = {
    "SECRET_MARKER": SECRET,
    "PRIVATE_PATH": PRIVATE_PATH,
    "PROMPT_OUTPUT_MARKER": r"(?i)\b(prompt_output|raw_prompt_output|01a_prompt|01r_prompt|prompt_bundle_id)\b",
    "RAW_PAYLOAD_MARKER": r"(?i)\b(full_extracted_text|raw_payload|raw_text|full_text)\b",
    "PRIVATE_NOTE_MARKER": r"(?i)\b(internal_note|private_note|operator_note|note_text)\b",
    "RESTRICTED_EVIDENCE_MARKER": r"(?i)\b(operator_excerpt_text|public_excerpt_text)\b",
    "RUNTIME_LOG_PATH": r"(?i)(?:^|/)(?:logs?|runtime-logs?|index-actions\.log)(?:/|$)",
}
URL = r"""https?://[^\s<>()"']+"""

#: Hazard families, text that addresses a model and markup that runs.
HAZARD_RULES = {
    "prompt_injection_text": r"(?i)(ignore previous instructions|\bsystem prompt\b|\bdeveloper message\b|\brun shell command\b|\btool call\b)",
    "hostile_markup": r"(<!--|(?i:<script)|</[A-Za-z])",
}


def squeeze(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def label_ascii(column: Column) -> Column:
    """Label normal form where letters are plain: one blank, lower case."""
    return F.lower(squeeze(column))


@F.pandas_udf(T.StringType())
def label_norm(values: pd.Series) -> pd.Series:
    """Label normal form for any script: compatibility composition, one blank, case folded (Arrow batches)."""
    import unicodedata

    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).casefold())


def label(column: Column) -> Column:
    """The label form that keys are made of: ASCII texts stay in the JVM, only others go through ``label_norm``."""
    plain = ~column.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(F.trim(F.regexp_replace(column, r"[\s\x1c-\x1f]+", " ")))).otherwise(label_norm(F.when(~plain, column)))


def slug(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", "-"), "(^-+)|(-+$)", "")


def truncate(column: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(column) > most, F.concat(F.rtrim(F.substring(column, 1, most - len(mark))), F.lit(mark))).otherwise(column)


def host(url: Column) -> Column:
    """The lower-cased authority of a URL, port included."""
    return F.lower(F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, "(" + URL + ")", 1), "[.,;]+$", ""), F.lit(""))


def object_ref(namespace: Column, key: Column) -> Column:
    return F.concat(namespace, F.lit(":"), key.cast("string"))


def ref_namespace(ref: Column) -> Column:
    return F.substring_index(ref, ":", 1)


def ref_key(ref: Column) -> Column:
    return F.regexp_extract(ref, "^[^:]*:(.*)$", 1)


def work_type(text: Column) -> Column:
    """The kind of work that a citation text speaks of: address, book, article."""
    low = F.lower(text)
    return (
        F.when(low.rlike("https?://|\\burl\\b"), "web_resource")
        .when(low.contains("isbn"), "book")
        .when(low.contains("doi") | low.contains("journal"), "article")
        .otherwise("unknown")
    )


def _check10(digits: Column) -> Column:
    weighted = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda total, i: total + i * F.substr(digits, i, F.lit(1)).cast("int"))
    last = F.when(F.substring(digits, 10, 1) == "X", 10).otherwise(F.substring(digits, 10, 1).try_cast("int"))
    return (weighted + 10 * last) % 11 == 0


def _check13(digits: Column) -> Column:
    weighted = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda total, i: total + F.when(i % 2 == 1, 1).otherwise(3) * F.substr(digits, i, F.lit(1)).cast("int"))
    return (10 - weighted % 10) % 10 == F.substring(digits, 13, 1).cast("int")


def identifier(scheme: Column, value: Column) -> Column:
    """struct(scheme, value, uri, status): the normal form of an identifier.

    status is valid, invalid or unsupported_scheme; http and https name the
    scheme url.  Check digits are judged for ISBN alone.
    """
    kind = F.lower(F.trim(F.coalesce(scheme, F.lit(""))))
    raw = F.trim(F.coalesce(value, F.lit("")))
    doi = F.lower(F.regexp_extract(raw, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)?(10\.\d{4,9}/\S+)$", 1))
    isbn = F.upper(F.regexp_replace(raw, "[^0-9Xx]", ""))
    isbn_ok = F.when(isbn.rlike("^[0-9]{9}[0-9X]$"), _check10(isbn)).when(isbn.rlike("^[0-9]{13}$"), _check13(isbn)).otherwise(False)
    issn = F.upper(F.regexp_replace(raw, "[^0-9Xx]", ""))
    orcid = F.upper(F.regexp_extract(raw, r"(?i)^(?:https?://orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[0-9Xx])$", 1))
    wikidata = F.upper(F.regexp_extract(raw, r"(?i)^([QP]\d+)$", 1))
    is_url = raw.rlike(r"(?i)^https?://[^/\s]+")

    def result(name: Column, ok: Column, good: Column, uri: Column, bad: Column) -> Column:
        return F.struct(name.alias("scheme"), F.when(ok, good).otherwise(bad).alias("value"), F.when(ok, uri).alias("uri"), F.when(ok, "valid").otherwise("invalid").alias("status"))

    none = F.lit(None).cast("string")
    other = F.struct(kind.alias("scheme"), raw.alias("value"), none.alias("uri"), F.lit("unsupported_scheme").alias("status"))
    return (
        F.when((kind == "") | (raw == ""), F.struct(kind.alias("scheme"), raw.alias("value"), none.alias("uri"), F.lit("invalid").alias("status")))
        .when(kind == "local", result(kind, F.lit(True), raw, none, raw))
        .when(kind == "doi", result(kind, doi != "", doi, F.concat(F.lit("https://doi.org/"), doi), F.lower(raw)))
        .when(kind == "isbn", result(kind, isbn_ok, isbn, F.concat(F.lit("urn:isbn:"), isbn), isbn))
        .when(kind == "issn", result(kind, issn.rlike("^[0-9]{7}[0-9X]$"), issn, F.concat(F.lit("urn:issn:"), issn), issn))
        .when(kind == "orcid", result(kind, orcid != "", orcid, F.concat(F.lit("https://orcid.org/"), orcid), raw))
        .when(kind == "wikidata", result(kind, wikidata != "", wikidata, F.concat(F.lit("https://www.wikidata.org/entity/"), wikidata), raw))
        .when(kind.isin("url", "http", "https"), result(F.lit("url"), is_url, raw, raw, raw))
        .otherwise(other)
    )


def text_profile(text: Column) -> Column:
    """struct of byte, line, URL and duplicate-block counts and the boilerplate verdict."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    # a final line end closes the last line and opens none
    lines = F.when(text == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    full = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: squeeze(b)), lambda b: b != "")
    repeated = F.size(blocks) - F.size(F.array_distinct(blocks))
    boilerplate = (repeated > 0) | ((F.size(full) >= 12) & (F.size(F.array_distinct(full)) * 2 <= F.size(full)))
    return F.struct(
        F.octet_length(text).alias("byte_count"),
        F.size(lines).alias("line_count"),
        F.size(F.regexp_extract_all(text, F.lit("(" + URL + ")"), 1)).alias("url_count"),
        repeated.alias("duplicate_block_count"),
        boilerplate.alias("likely_boilerplate"),
    )


def profile_flags(profile: Column) -> Column:
    return F.array_compact(
        F.array(F.when(profile["duplicate_block_count"] > 0, "duplicate_blocks"), F.when(profile["likely_boilerplate"], "likely_boilerplate"), F.when(profile["url_count"] >= 5, "url_heavy"))
    )


def rule_hits(text: Column, rules: dict[str, str]) -> Column:
    """The names of the rules that match, in the rules' order."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), name) for name, pattern in rules.items())))


def snippet(text: Column, terms: list[str], size: int = 120, lead: int = 24) -> Column:
    """A window of the text around the first term; private paths are withheld."""
    low = F.lower(text)
    hits = [F.nullif(F.instr(low, t), F.lit(0)) for t in terms]
    at = hits[0] if len(hits) == 1 else F.least(*hits)
    start = F.greatest(at - 1 - lead, F.lit(0))
    stop = F.least(start + size, F.length(text))
    window = F.concat(F.when(start > 0, "...").otherwise(""), F.substr(text, start + 1, stop - start), F.when(stop < F.length(text), "...").otherwise(""))
    return F.when(text.rlike(PRIVATE_PATH), "[suppressed private path]").when(at.isNull(), F.substring(text, 1, size)).otherwise(window)


def question_quality(claim_text: Column, claim_type: Column, facet: Column | None = None) -> Column:
    """The bonus of an open question for its length, question words and shape."""
    text = squeeze(F.coalesce(claim_text, F.lit("")))
    words = F.filter(F.transform(F.split(text, " "), lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", ""))), lambda w: w != "")
    n = F.size(words)
    terms = F.array(*map(F.lit, vocab.QUESTION_TERMS))
    asked = F.size(F.filter(F.slice(words, 1, 4), lambda w: F.array_contains(terms, w)))
    long = F.size(F.filter(words, lambda w: (F.length(w) > 4) & ~F.array_contains(terms, w)))
    bonus = (
        F.least(F.greatest(n - 4, F.lit(0)), F.lit(10)) * 0.08
        + F.least(long, F.lit(4)) * 0.05
        + F.when(text.contains("?"), 0.25).otherwise(0.0)
        + F.least(asked, F.lit(2)) * 0.25
        + F.when(n >= 8, 0.15).otherwise(0.0)
        - F.when(n <= 3, 0.4).otherwise(0.0)
        + F.when(F.lower(F.coalesce(claim_type, F.lit(""))).contains("open_question"), 0.15).otherwise(0.0)
        + (F.lit(0.0) if facet is None else F.when(facet == "open_questions", 0.1).otherwise(0.0))
    )
    return F.when(n == 0, -0.75).otherwise(bonus)


def glob_to_regex(glob: str, slash_aware: bool = True) -> str:
    """A path glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` don't when ``slash_aware``."""
    out, i = "", 0
    one, many = ("[^/]", "[^/]*") if slash_aware else (".", ".*")
    while i < len(glob):
        if slash_aware and glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": many, "?": one}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def normalize_extracted(text: Column) -> Column:
    """Extracted text with form feeds as paragraph breaks, single blanks and at most one empty line."""
    out = F.regexp_replace(text, "\\f", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), "\n{3,}", "\n\n"))
