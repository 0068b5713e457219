"""Licence scans by canonical digests, on DataFrames only.

Each line of a text is put in canonical form once: lower case, one spelling
for words that have several, letters and digits only with single blanks
between, nothing where the line is an attribution.  An attribution begins with "copyright" or "(c)" and goes on with a
sign, a year or a name; where a line of a licence's body begins so ("copyright
notice and ..."), it stays.  Three kinds of SHA-256 digest are looked up among those
of known licences:

* the entire text's, hash-joined with the known ones: ``license_id``;
* those of runs of whole paragraphs, however their lines are wrapped, so that a
  licence inside a longer text is found: ``block_licenses``;
* those of single lines among known notices: ``n_notice_lines``, ``notices``.

The scan is one map over the table.  Known digests are counted first: whole
texts are broadcast up to ``KNOWN_MOST`` and left to Spark's join beyond that;
paragraphs and notices, of which a table of licences has few, are literals of
the plan, and more than ``KNOWN_MOST`` are refused.

Edge cases: a null text has a null digest and no licence; a text without a
letter or digit is canonically empty and matches nothing; several licences with
one canonical form give the least name; rows that repeat wholly each return
their result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pkgutil
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Spellings that are taken as equal, in order (found, read as).
SPELLINGS = [
    ("licence", "license"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("noninfringement", "non infringement"),
    ("whilst", "while"),
    ("http://", "https://"),
]

#: What follows "copyright", or "(c)" as an item's letter, where a line is a licence's body and no attribution.
BODY = "the software|the library|the program|notices?|holders?|owners?|ownership|laws?|licen[cs]e[sd]?|statements?|permissions?|doctrines?|disclaimers?|treaty|treaties|interests?|protections?|patents?|lines?|like|also|and|or|on|in|to|of|for|if|is|are|as|that|those|this|which|under|with|from|shall|may|must"
ITEM = "you|under|to|for|if|in|an?|any|all"
ATTRIBUTION = r"^[^\p{L}\p{N}]*(copyright\b|\(c\)|©|all rights reserved)"
NO_ATTRIBUTION = rf"^[^\p{{L}}\p{{N}}]*(copyright[^\p{{L}}\p{{N}}]*($|({BODY})\b)|\(c\)[^\p{{L}}\p{{N}}]*({ITEM})\b)"
NOT_WORD = r"[^\p{L}\p{N}]+"
KNOWN_MOST = 10_000

#: Known licence texts.
LICENSES = {
    "MIT": """MIT License

Copyright (c) <year> <holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

Copyright (C) <year> <holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}

#: Further known texts, in the folder ``licenses``.
FILES = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]

#: Titles that texts are shipped with or, the empty one, without.
TITLES = {
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "Zlib": ["", "zlib License", "The zlib License", "zlib/libpng License"],
}

#: Known notices, each a line of its own.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
}


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line of a text."""
    spelled = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, F.lower(text))
    words = lambda line: F.trim(F.regexp_replace(line, NOT_WORD, " "))
    attribution = lambda line: line.rlike(ATTRIBUTION) & ~line.rlike(NO_ATTRIBUTION)
    return F.transform(F.split(spelled, "\n"), lambda line: F.when(attribution(line), "").otherwise(words(line)))


def digest(words: Column) -> Column:
    """The digest of canonical words."""
    return F.sha2(words, 256)


def entire(lines: Column) -> Column:
    """Canonical lines as one run of words."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def paragraphs(lines: Column) -> Column:
    """The digests of the paragraphs of canonical lines; a paragraph ends at a line without words."""
    runs = F.split(F.trim(F.array_join(lines, "\n"), F.lit("\n")), "\n\n+")
    return F.transform(F.filter(runs, lambda x: x != ""), lambda x: digest(F.replace(x, F.lit("\n"), F.lit(" "))))


def known_forms() -> dict[str, list[str]]:
    """All known texts: with each title or none, items with and without numbers, and without what follows the terms."""
    texts = LICENSES | {name: pkgutil.get_data(__package__, f"licenses/{name}.txt").decode() for name in FILES}
    forms = {}
    for name, text in texts.items():
        body = text.removeprefix(text.split("\n", 1)[0]) if name in TITLES and name in LICENSES else text
        bodies = [body, re.sub(r"(?m)^\s*\d\.\s", "", body)] if name in TITLES else [body]
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        forms[name] = [text, *(f"{title}\n{b}" for title in TITLES.get(name, [""]) for b in bodies), *([terms, terms + end] if end else [])]
    return forms


def _texts(spark: SparkSession, known: dict[str, list[str]]) -> DataFrame:
    rows = [(name, text) for name, texts in known.items() for text in texts]
    lines = spark.createDataFrame(rows, "license_id string, text string").select("license_id", canonical_lines(F.col("text")).alias("lines"))
    return lines.filter(entire(F.col("lines")) != "")


def known_digests(spark: SparkSession, licenses: dict[str, list[str]]) -> DataFrame:
    """(digest, license_id) of each distinct canonical form."""
    return _texts(spark, licenses).groupBy(digest(entire(F.col("lines"))).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_blocks(spark: SparkSession, licenses: dict[str, list[str]]) -> DataFrame:
    """(first, n, digest, license_id): first paragraph, number of paragraphs and digest of each distinct form's run of paragraphs."""
    rows = _texts(spark, licenses).select("license_id", paragraphs(F.col("lines")).alias("p"))
    return rows.groupBy(F.get("p", F.lit(0)).alias("first"), F.size("p").alias("n"), block_digest(F.col("p")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def block_digest(run: Column) -> Column:
    return F.sha2(F.array_join(run, " "), 256)


def _bounded(known: DataFrame, what: str) -> list[Row]:
    rows = known.limit(KNOWN_MOST + 1).collect()
    if len(rows) > KNOWN_MOST:
        raise ValueError(f"more than {KNOWN_MOST} {what}")
    return rows


def _named(digests: Column, names: dict[str, str]) -> Column:
    """The names of known digests, in order of occurrence."""
    if not names:
        return F.array().cast("array<string>")
    by_digest = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform(F.filter(digests, lambda d: d.isin(*names)), lambda d: F.element_at(by_digest, d))


def scan(docs: DataFrame, licenses: DataFrame, notices: DataFrame, blocks: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(doc_id, text_digest, license_id, block_licenses, n_notice_lines, notices) for each row.

    ``licenses`` and ``notices`` have (digest, license_id), ``blocks`` what ``known_blocks`` returns, one row for each digest.
    """
    notice = {r.digest: r.license_id for r in _bounded(notices, "notices")}
    block = _bounded(blocks, "blocks") if blocks is not None else []
    few = len(licenses.limit(KNOWN_MOST + 1).collect()) <= KNOWN_MOST

    rows = docs.select("doc_id", canonical_lines(F.col(text)).alias("lines"))
    rows = rows.select("doc_id", digest(entire(F.col("lines"))).alias("text_digest"), F.transform("lines", digest).alias("line_digests"), paragraphs(F.col("lines")).alias("p"))
    # places where a known block may begin, then the runs from there that are as long as one
    starts = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.get("p", i - 1).isin(*{r["first"] for r in block}) if block else F.lit(False))
    lengths = F.array(*(F.lit(n) for n in sorted({r.n for r in block}))) if block else F.array().cast("array<int>")
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(lengths, lambda n: i + n - 1 <= F.size("p")), lambda n: block_digest(F.slice("p", i, n)))))
    rows = rows.select("doc_id", "text_digest", _named(F.col("line_digests"), notice).alias("found"), F.when(F.size("p") > 0, _named(runs, {r.digest: r.license_id for r in block})).alias("inside"))

    known = licenses.withColumnRenamed("digest", "text_digest")
    names = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(F.array_distinct(c)), ","))
    return rows.join(F.broadcast(known) if few else known, "text_digest", "left").select(
        "doc_id", "text_digest", "license_id", names("inside").alias("block_licenses"), F.coalesce(F.greatest(F.size("found"), F.lit(0)), F.lit(0)).cast("long").alias("n_notice_lines"), names("found").alias("notices")
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences and notices of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forms = known_forms()
    return scan(docs, known_digests(spark, forms), known_digests(spark, NOTICES), known_blocks(spark, forms))


def _lines_sql(x: str) -> str:
    x = f"lower({x})"
    for found, read_as in SPELLINGS:
        x = f"replace({x}, '{found}', '{read_as}')"
    return (
        f"list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '{ATTRIBUTION}') AND NOT regexp_matches(l, '{NO_ATTRIBUTION}') THEN '' "
        f"ELSE trim(regexp_replace(l, '{NOT_WORD}', ' ', 'g')) END)"
    )


def _digest_sql(x: str) -> str:
    return f"sha256({x})"


def _values(known: dict[str, list[str]]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(name)}, {quote(text)})" for name, texts in known.items() for text in texts)


_ENTIRE = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
_PARAGRAPHS = f"list_transform(list_filter(regexp_split_to_array(trim(array_to_string(lines, chr(10)), chr(10)), '\n\n+'), lambda x: x <> ''), lambda x: {_digest_sql('replace(x, chr(10), chr(32))')})"

OP4_SQL = f"""
WITH forms AS (
  SELECT name, {_lines_sql("t")} AS lines FROM (VALUES {_values(known_forms())}) AS l(name, t)
), licenses AS (
  SELECT {_digest_sql(_ENTIRE)} AS digest, min(name) AS license_id FROM forms GROUP BY 1
), blocks AS (
  SELECT p, len(p) AS n, p[1] AS p1, min(name) AS name FROM (SELECT name, {_PARAGRAPHS} AS p FROM forms) GROUP BY 1, 2, 3
), notices AS (
  SELECT {_digest_sql(_ENTIRE)} AS digest, min(name) AS notice FROM (SELECT name, {_lines_sql("t")} AS lines FROM (VALUES {_values(NOTICES)}) AS l(name, t)) GROUP BY 1
), docs AS (
  SELECT doc_id, lines, {_PARAGRAPHS} AS p FROM (SELECT doc_id, {_lines_sql("text")} AS lines FROM documents)
), found AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT notice)), ',') AS notices
  FROM (SELECT doc_id, unnest(lines) AS line FROM docs) JOIN notices ON {_digest_sql("line")} = digest GROUP BY doc_id
), places AS (
  SELECT doc_id, p AS ps, unnest(p) AS p1, unnest(range(1, len(p) + 1)) AS i FROM docs
), inside AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM places JOIN blocks USING (p1) WHERE ps[i:i + n - 1] = p GROUP BY doc_id
)
SELECT docs.doc_id, {_digest_sql(_ENTIRE)} AS text_digest, license_id, names AS block_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_notice_lines, notices
FROM docs LEFT JOIN licenses ON {_digest_sql(_ENTIRE)} = digest LEFT JOIN found ON found.doc_id = docs.doc_id LEFT JOIN inside ON inside.doc_id = docs.doc_id
"""
