"""Search, text scans, identifiers and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import states, text, values
from ..operators import scan, search
from ..session import use_checkpoint_dir
from .views import WORKS, read, works



def _projection(spark, d, profile="local"):
    rows = works(spark, d, text=True).select(
        F.lit("work").alias("object_type"), F.col("work_id").alias("object_pk"), F.when(F.col("work_id") % 9 > 0, F.col("title")).alias("title"), F.col("work_type").alias("subtitle"), F.col("body").alias("indexed_text"),
        F.when(F.col("work_id") % 4 == 0, "reviewed").when(F.col("work_id") % 4 == 1, "accepted").otherwise(F.col("review_state")).alias("review_state"), "publication_state", "public_blocker", "confidence_score",
        F.when(F.col("work_id") % 6 == 0, "primary").when(F.col("work_id") % 6 == 1, "secondary").alias("authority_level"), F.when(F.col("work_id") % 11 == 0, "superseded").otherwise("current").alias("lineage_state"),
    )
    return search.project(rows, profile)


PROJECTION = f"""{WORKS}, p AS (
  SELECT work_id AS pk, CASE WHEN work_id % 9 > 0 AND trim(title) <> '' THEN trim(title) ELSE 'Work ' || work_id END AS title, work_type AS subtitle, body, confidence_score, public_blocker,
    CASE work_id % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'accepted' ELSE review_state END AS review_state, CASE publication_state WHEN 'published' THEN 'public_release_allowed' ELSE 'private_working' END AS publication,
    CASE work_id % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' END AS authority, CASE WHEN work_id % 11 = 0 THEN 'superseded' ELSE 'current' END AS lineage FROM works
)"""


def search_projection(spark, d):
    rows = _projection(spark, d, "public_preview")
    return rows.select("object_ref", "title", "result_class", F.array_join("visible_profiles", ",").alias("profiles"), "exclusion_reason")


def search_exclusions(spark, d):
    return _projection(spark, d).groupBy(F.coalesce("exclusion_reason", F.lit("[searchable]")).alias("reason")).agg(F.count("*").alias("n"))


def postings_df(spark, d):
    return search.postings(read(spark, d, "documents"), "doc_id", ["text"]).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def bm25_scores(spark, d):
    hits = search.bm25(read(spark, d, "documents"), "doc_id", ["text"], "the of")
    return hits.select("doc_id", F.round("bm25", 6).alias("bm25"))


def bm25_topk(spark, d):
    page = search.search(_projection(spark, d), "the of", "source_work")
    return page.select("object_ref", "object_type", "result_class", "title", F.round("score", 6).alias("score"))


def search_match_count(spark, d):
    return search.match_count(_projection(spark, d), "der und", "all")


BM25 = r"""words AS (SELECT doc_id, regexp_extract_all(lower({text}), '[0-9A-Za-z]+') AS w FROM {source}),
c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'of')) AS t1 FROM words),
f AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
hits AS (SELECT doc_id, -greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / av)) - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / av)) AS bm25 FROM c, f WHERE t0 > 0 AND t1 > 0)"""


def _index(spark, d):
    use_checkpoint_dir(spark)
    rows = _projection(spark, d)
    return search.Index(spark, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}").build(rows), rows


def indexed_topk(spark, d):
    """The page of bm25_topk from a stored index."""
    index, rows = _index(spark, d)
    return index.search(rows, "the of", "source_work").select("object_ref", "object_type", "result_class", "title", F.round("score", 6).alias("score"))


def indexed_match_count(spark, d):
    return _index(spark, d)[0].match_count("der und", "all")


def snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), ["the", "und"]).alias("snippet"))


def identifier_validity(spark, d):
    kinds = F.array(*map(F.lit, ["doi", "isbn", "issn", "orcid", "wikidata", "url", "https", "local", "ark", "", "isbn"]))
    key = F.col("p_partkey")
    isbn13 = F.lpad((F.lit(978000000000) + key * 37).cast("string"), 12, "0")
    values_ = F.array(
        F.concat(F.when(key % 2 == 0, "doi:10.1234/AbC").otherwise("https://doi.org/10.99/x"), key.cast("string")), F.concat(isbn13, (key % 10).cast("string")), F.concat(F.lit("1234-"), F.lpad(key.cast("string"), 4, "0")),
        F.concat(F.lit("https://orcid.org/0000-0002-1825-"), F.lpad(key.cast("string"), 4, "0")), F.concat(F.lit("q"), key.cast("string")), F.concat(F.lit("http://example.com/"), key.cast("string")), F.lit("https:///nohost"), key.cast("string"), F.lit("ark:/1"), F.lit("x"),
        F.concat(F.lpad((key * 7919).cast("string"), 9, "0"), F.when(key % 11 == 10, "X").otherwise((key % 11).cast("string"))),
    )
    rows = read(spark, d, "part").select(key, (key % 11).cast("int").alias("i"))
    rows = rows.select("p_partkey", text.identifier(kinds[F.col("i")], values_[F.col("i")]).alias("x"))
    return rows.select("p_partkey", "x.scheme", "x.value", "x.uri", "x.status")


IDENTIFIER_SQL = r"""WITH raw AS (SELECT p_partkey AS k, p_partkey % 11 AS i FROM part),
v AS (SELECT k, i, CASE i WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'doi:10.1234/AbC' ELSE 'https://doi.org/10.99/x' END || k WHEN 1 THEN lpad(CAST(978000000000 + k * 37 AS VARCHAR), 12, '0') || (k % 10) WHEN 2 THEN '1234-' || lpad(CAST(k AS VARCHAR), 4, '0')
  WHEN 3 THEN 'https://orcid.org/0000-0002-1825-' || lpad(CAST(k AS VARCHAR), 4, '0') WHEN 4 THEN 'q' || k WHEN 5 THEN 'http://example.com/' || k WHEN 6 THEN 'https:///nohost' WHEN 7 THEN CAST(k AS VARCHAR) WHEN 8 THEN 'ark:/1' WHEN 9 THEN 'x'
  ELSE lpad(CAST(k * 7919 AS VARCHAR), 9, '0') || CASE WHEN k % 11 = 10 THEN 'X' ELSE CAST(k % 11 AS VARCHAR) END END AS raw FROM raw),
n AS (SELECT k, i, raw, upper(regexp_replace(raw, '[^0-9Xx]', '', 'g')) AS digits, lower(regexp_extract(raw, '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)?(10\.\d{4,9}/\S+)$', 1)) AS doi FROM v),
c AS (SELECT *, list_sum(list_transform(range(1, 13), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE 3 END * TRY_CAST(substr(digits, j, 1) AS INTEGER))) AS s13,
  list_sum(list_transform(range(1, 10), lambda j: j * TRY_CAST(substr(digits, j, 1) AS INTEGER))) + 10 * CASE WHEN substr(digits, 10, 1) = 'X' THEN 10 ELSE TRY_CAST(substr(digits, 10, 1) AS INTEGER) END AS s10 FROM n),
o AS (SELECT *, CASE i WHEN 0 THEN doi <> '' WHEN 1 THEN len(digits) = 13 AND (10 - s13 % 10) % 10 = CAST(substr(digits, 13, 1) AS INTEGER) WHEN 10 THEN len(digits) = 10 AND s10 % 11 = 0 WHEN 2 THEN len(digits) = 8 WHEN 3 THEN len(raw) = 37 WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN false WHEN 7 THEN true END AS ok FROM c)
SELECT k AS p_partkey, (['doi', 'isbn', 'issn', 'orcid', 'wikidata', 'url', 'url', 'local', 'ark', '', 'isbn'])[i + 1] AS scheme,
  CASE i WHEN 0 THEN CASE WHEN ok THEN doi ELSE lower(raw) END WHEN 1 THEN digits WHEN 10 THEN digits WHEN 2 THEN digits WHEN 3 THEN CASE WHEN ok THEN right(raw, 19) ELSE raw END WHEN 4 THEN upper(raw) ELSE raw END AS value,
  CASE WHEN ok THEN CASE i WHEN 0 THEN 'https://doi.org/' || doi WHEN 1 THEN 'urn:isbn:' || digits WHEN 10 THEN 'urn:isbn:' || digits WHEN 2 THEN 'urn:issn:' || digits WHEN 3 THEN raw WHEN 4 THEN 'https://www.wikidata.org/entity/' || upper(raw) WHEN 5 THEN raw END END AS uri,
  CASE WHEN i = 8 THEN 'unsupported_scheme' WHEN ok THEN 'valid' ELSE 'invalid' END AS status FROM o"""


def url_host_counts(spark, d):
    return read(spark, d, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def first_urls(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_url(F.concat(F.col("text"), F.lit(" see https://example.org/"), F.col("doc_id").cast("string"), F.lit(".;"))).alias("url"))


def leak_findings(spark, d):
    return scan.leak_findings(read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "code")


def leak_findings_allowed(spark, d):
    allow = read(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", F.lit("SECRET_MARKER").alias("code"))
    return scan.leak_findings(read(spark, d, "documents"), "doc_id", "text", allow=allow).groupBy("code").agg(F.count("*").alias("n"))


def hazard_flags(spark, d):
    docs = read(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    rows = docs.unionByName(read(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")))
    return rows.select("kind", "id", F.array_join(text.rule_hits(F.col("body"), text.HAZARD_RULES), ",").alias("flags")).filter("flags != ''")


def text_profile(spark, d):
    p = text.text_profile(F.col("text"))
    return read(spark, d, "documents").select("doc_id", p.alias("p")).select("doc_id", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("byte_count", "line_count", "url_count", "duplicate_block_count")), "p.likely_boilerplate", F.array_join(text.profile_flags(F.col("p")), ",").alias("flags"))


def redacted_texts(spark, d):
    docs = read(spark, d, "documents")
    return docs.filter(F.col("text").rlike(text.SECRET)).select("doc_id", F.md5(F.encode(scan.redact(F.col("text")), "UTF-8")).alias("digest"))


def chunk_text(spark, d):
    return scan.chunk_texts(read(spark, d, "documents"), "doc_id", "text", size=2048)


def question_quality(spark, d):
    kind = F.when(F.col("turn") % 3 == 0, "open_question").otherwise(F.col("role"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.round(text.question_quality(F.concat(F.when(F.col("turn") % 2 == 0, "What is ").otherwise(""), F.col("text"), F.when(F.col("turn") % 4 == 0, "?").otherwise("")), kind), 4).alias("bonus"), states.is_open_question(F.col("text"), kind).alias("is_open"))


QUESTION_SQL = r"""WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'open_question' ELSE role END AS kind,
  trim(regexp_replace((CASE WHEN turn % 2 = 0 THEN 'What is ' ELSE '' END) || text || (CASE WHEN turn % 4 = 0 THEN '?' ELSE '' END), '\s+', ' ', 'g')) AS q FROM conversations),
w AS (SELECT *, list_filter(list_transform(string_split(q, ' '), lambda x: lower(regexp_replace(x, '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g'))), lambda x: x <> '') AS ws FROM t),
n AS (SELECT *, len(ws) AS n, len(list_filter(ws[1:4], lambda x: list_contains(['how','what','when','where','whether','which','who','whom','whose','why'], x))) AS asked,
  len(list_filter(ws, lambda x: len(x) > 4 AND NOT list_contains(['how','what','when','where','whether','which','who','whom','whose','why'], x))) AS long_words FROM w)
SELECT conv_id, turn, CAST(CASE WHEN n = 0 THEN -0.75 ELSE round(CAST(least(greatest(n - 4, 0), 10) * 0.08 + least(long_words, 4) * 0.05 + CASE WHEN contains(q, '?') THEN 0.25 ELSE 0.0 END + least(asked, 2) * 0.25
  + CASE WHEN n >= 8 THEN 0.15 ELSE 0.0 END - CASE WHEN n <= 3 THEN 0.4 ELSE 0.0 END + CASE WHEN contains(kind, 'open_question') THEN 0.15 ELSE 0.0 END AS DOUBLE), 4) END AS DOUBLE) AS bonus,
  contains(lower(kind), 'question') OR contains(text, '?') AS is_open FROM n"""


def scalar_texts(spark, d):
    name = F.concat(F.col("p_name"), F.lit("  "), F.upper("p_type"), F.lit(" (New)"))
    cite = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, " ISBN 1").when(F.col("p_partkey") % 4 == 1, " doi:10").when(F.col("p_partkey") % 4 == 2, " https://x.org").otherwise(""))
    return read(spark, d, "part").select("p_partkey", text.label_ascii(name).alias("label"), text.slug(name).alias("slug"), text.truncate(name, 12).alias("short"), text.work_type(cite).alias("work_type"))


def scalar_values(spark, d):
    v, year = F.col("p_retailprice") - 905, F.concat(F.when(F.col("p_partkey") % 3 == 0, "18").when(F.col("p_partkey") % 3 == 1, "x").otherwise("2"), (F.col("p_size") + 10).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-05-01").otherwise(""))
    payload = F.concat(F.lit('{"numeric_value": "'), F.col("p_size").cast("string"), F.lit('", "year": 5}'))
    return read(spark, d, "part").select("p_partkey", F.round(values.clamp(v, 0, 3), 4).alias("clamped"), values.year(year).alias("year"), values.quantity(payload).alias("quantity"), values.confidence_band(F.round(v / 10, 4)).alias("band"), values.productivity(F.col("p_size"), F.lit(1), F.lit(2), F.col("p_partkey") % 4).alias("productivity"))


def confidence_bands(spark, d):
    return works(spark, d).groupBy(F.coalesce(values.confidence_band(F.col("confidence_score")), F.lit("[none]")).alias("band")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        search_projection, search_exclusions, postings_df, bm25_scores, bm25_topk, search_match_count, indexed_topk, indexed_match_count, snippets, identifier_validity, url_host_counts, first_urls, leak_findings, leak_findings_allowed,
        hazard_flags, text_profile, redacted_texts, chunk_text, question_quality, scalar_texts, scalar_values, confidence_bands,
    )
}

_REASON = """CASE WHEN pk IS NULL THEN 'missing_pk' WHEN review_state NOT IN ('accepted', 'approved', 'curated', 'reviewed') THEN 'review_state_not_searchable' {public} WHEN trim(body) = '' THEN 'no_indexable_fields' END"""
_PUBLIC = "WHEN lineage = 'superseded' THEN 'superseded_in_public_profile' WHEN public_blocker IS NOT NULL THEN 'public_blocker' WHEN publication = 'private_working' THEN 'publication_state_not_public'"


def _pattern(p: str) -> str:
    return p.replace("'", "''")


_CODES = ", ".join(f"CASE WHEN regexp_matches(line, '{_pattern(p)}') THEN '{n}' END" for n, p in text.LEAK_RULES.items())
_LEAKS = f"lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), found AS (SELECT doc_id, line_no, unnest(list_filter([{_CODES}], lambda x: x IS NOT NULL)) AS code FROM lines)"
_HAZARDS = ", ".join(f"CASE WHEN regexp_matches(body, '{_pattern(p)}') THEN '{n}' END" for n, p in text.HAZARD_RULES.items())

ORACLE = {
    "search_projection": f"""WITH {PROJECTION} SELECT 'work:' || pk AS object_ref, title, 'work' AS result_class, CASE WHEN public_blocker IS NOT NULL OR lineage = 'superseded' OR publication = 'private_working' THEN 'local' ELSE 'local,public_preview,public_release' END AS profiles,
  {_REASON.format(public=_PUBLIC)} AS exclusion_reason FROM p""",
    "search_exclusions": f"WITH {PROJECTION} SELECT coalesce({_REASON.format(public='')}, '[searchable]') AS reason, count(*) AS n FROM p GROUP BY 1",
    "postings_df": "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY term",
    "bm25_scores": f"WITH {BM25.format(text='text', source='documents')} SELECT doc_id, round(bm25, 6) AS bm25 FROM hits",
    "bm25_topk": f"""WITH {PROJECTION}, q AS (SELECT *, pk AS doc_id FROM p WHERE {_REASON.format(public='')} IS NULL), {BM25.format(text="'work:' || doc_id || ' work ' || title || ' ' || subtitle || ' ' || body", source='q')}
SELECT 'work:' || pk AS object_ref, 'work' AS object_type, 'work' AS result_class, title, round(bm25 * 0.95 + CASE authority WHEN 'primary' THEN -0.35 WHEN 'secondary' THEN -0.10 ELSE 0.0 END + CASE review_state WHEN 'reviewed' THEN -0.03 ELSE 0.0 END - confidence_score * 0.75, 6) AS score
FROM q JOIN hits USING (doc_id) ORDER BY bm25 * 0.95 + CASE authority WHEN 'primary' THEN -0.35 WHEN 'secondary' THEN -0.10 ELSE 0.0 END + CASE review_state WHEN 'reviewed' THEN -0.03 ELSE 0.0 END - confidence_score * 0.75, pk LIMIT 20""",
    "search_match_count": f"""WITH {PROJECTION} SELECT count(*) AS matches FROM (SELECT regexp_extract_all(lower('work:' || pk || ' work ' || title || ' ' || subtitle || ' ' || body), '[0-9A-Za-z]+') AS w FROM p WHERE {_REASON.format(public='')} IS NULL) WHERE list_contains(w, 'der') AND list_contains(w, 'und')""",
    "snippets": f"""WITH s AS (SELECT doc_id, text, least(nullif(instr(lower(text), 'the'), 0), nullif(instr(lower(text), 'und'), 0)) AS pos FROM documents), b AS (SELECT *, greatest(pos - 25, 0) AS a, least(greatest(pos - 25, 0) + 120, length(text)) AS z FROM s)
SELECT doc_id, CASE WHEN regexp_matches(text, '{_pattern(text.PRIVATE_PATH)}') THEN '[suppressed private path]' WHEN pos IS NULL THEN substr(text, 1, 120) ELSE (CASE WHEN a > 0 THEN '...' ELSE '' END) || substr(text, a + 1, z - a) || (CASE WHEN z < length(text) THEN '...' ELSE '' END) END AS snippet FROM b""",
    "identifier_validity": IDENTIFIER_SQL,
    "url_host_counts": "SELECT lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '')) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "first_urls": r"""SELECT doc_id, regexp_replace(regexp_extract(text || ' see https://example.org/' || doc_id || '.;', '(https?://[^\s<>()"'']+)', 1), '[.,;]+$', '') AS url FROM documents""",
    "leak_findings": f"WITH {_LEAKS} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, code FROM found",
    "leak_findings_allowed": f"WITH {_LEAKS} SELECT code, count(*) AS n FROM found WHERE NOT (code = 'SECRET_MARKER' AND doc_id % 2 = 0) GROUP BY code",
    "hazard_flags": f"""WITH b AS (SELECT 'document' AS kind, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'page', page_id, html FROM pages), f AS (SELECT kind, id, array_to_string(list_filter([{_HAZARDS}], lambda x: x IS NOT NULL), ',') AS flags FROM b) SELECT * FROM f WHERE flags <> ''""",
    "text_profile": r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '') AS bs FROM documents),
c AS (SELECT doc_id, strlen(text) AS byte_count, len(ls) - CASE WHEN ls[-1] = '' THEN 1 ELSE 0 END AS line_count, len(regexp_extract_all(text, 'https?://[^\s<>()"'']+')) AS url_count, len(bs) - len(list_distinct(bs)) AS duplicate_block_count,
  list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS fs FROM l),
v AS (SELECT doc_id, CAST(byte_count AS BIGINT) AS byte_count, CAST(line_count AS BIGINT) AS line_count, CAST(url_count AS BIGINT) AS url_count, CAST(duplicate_block_count AS BIGINT) AS duplicate_block_count,
  duplicate_block_count > 0 OR (len(fs) >= 12 AND len(list_distinct(fs)) * 2 <= len(fs)) AS likely_boilerplate FROM c)
SELECT *, array_to_string(list_filter([CASE WHEN duplicate_block_count > 0 THEN 'duplicate_blocks' END, CASE WHEN likely_boilerplate THEN 'likely_boilerplate' END, CASE WHEN url_count >= 5 THEN 'url_heavy' END], lambda x: x IS NOT NULL), ',') AS flags FROM v""",
    "redacted_texts": f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_pattern(text.SECRET)}', '[secret]', 'g'), '{_pattern(text.URL)}', '[url]', 'g'), '{_pattern(text.PRIVATE_PATH)}', ' [path]', 'g')) AS digest FROM documents WHERE regexp_matches(text, '{_pattern(text.SECRET)}')",
    "question_quality": QUESTION_SQL,
    "scalar_texts": """WITH n AS (SELECT p_partkey, p_name || '  ' || upper(p_type) || ' (New)' AS name, p_partkey % 4 AS m FROM part) SELECT p_partkey, lower(regexp_replace(name, '\\s+', ' ', 'g')) AS label,
  regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '(^-+)|(-+$)', '', 'g') AS slug, CASE WHEN length(name) > 12 THEN rtrim(substr(name, 1, 9)) || '...' ELSE name END AS short, CASE m WHEN 0 THEN 'book' WHEN 1 THEN 'article' WHEN 2 THEN 'web_resource' ELSE 'unknown' END AS work_type FROM n""",
    "scalar_values": """SELECT p_partkey, round(greatest(0.0, least(3.0, p_retailprice - 905)), 4) AS clamped, CAST(CASE WHEN p_partkey % 3 = 1 THEN NULL WHEN p_partkey % 2 = 1 THEN CAST((CASE WHEN p_partkey % 3 = 0 THEN '18' ELSE '2' END) || (p_size + 10) AS INTEGER) WHEN p_partkey % 3 = 0 THEN 1800 + p_size + 10 END AS INTEGER) AS year,
  CAST(p_size AS DOUBLE) AS quantity, CASE WHEN b < 0 OR b > 1 THEN NULL WHEN b < 0.25 THEN 'very_low' WHEN b < 0.5 THEN 'low' WHEN b < 0.75 THEN 'medium' WHEN b < 0.9 THEN 'high' ELSE 'very_high' END AS band,
  round(least(1.0, (p_size + 10) / greatest(1, 10 * (p_partkey % 4))), 4) AS productivity FROM (SELECT *, round((p_retailprice - 905) / 10, 4) AS b FROM part)""",
    "confidence_bands": f"WITH {WORKS} SELECT CASE WHEN confidence_score < 0.25 THEN 'very_low' WHEN confidence_score < 0.5 THEN 'low' WHEN confidence_score < 0.75 THEN 'medium' WHEN confidence_score < 0.9 THEN 'high' ELSE 'very_high' END AS band, count(*) AS n FROM works GROUP BY 1",
}
ORACLE |= {"indexed_topk": ORACLE["bm25_topk"], "indexed_match_count": ORACLE["search_match_count"]}
