"""Search projection, inverted index, ranking and snippets."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.states import exclusion_reason, lookup, visible_profiles
from ..functions.text import snippet

TOKEN = "[0-9A-Za-z]+"


def query_terms(query: str) -> list[str]:
    """The lower-cased ASCII terms of a plain query, all of which must match."""
    terms = [t.lower() for t in re.findall(TOKEN, query)]
    if not terms:
        raise ValueError("query does not contain any searchable alphanumeric terms")
    return list(dict.fromkeys(terms))


def project(rows: DataFrame, profile: str = "local") -> DataFrame:
    """Search documents of ``rows`` with an exclusion reason (null: searchable) for the profile.

    ``rows`` has object_type, object_pk, title, subtitle, indexed_text and the state columns.
    """
    lineage = F.coalesce("lineage_state", F.lit("current")) if "lineage_state" in rows.columns else F.lit("current")
    reason = exclusion_reason(F.col("object_pk"), F.col("review_state"), F.col("publication_state"), F.col("public_blocker"), lineage, F.col("indexed_text"), profile != "local")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.initcap(F.replace("object_type", F.lit("_"), F.lit(" "))), F.lit(" "), F.col("object_pk").cast("string")))
    return rows.withColumns(
        {
            "title": title,
            "object_ref": F.concat_ws(":", "object_type", F.col("object_pk").cast("string")),
            "result_class": lookup(F.col("object_type"), vocab.RESULT_CLASS),
            "visible_profiles": visible_profiles(F.col("publication_state"), F.col("public_blocker"), lineage),
            "exclusion_reason": reason,
        }
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, key, tf) over the given columns together."""
    joined = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    return docs.select(key, F.explode(tokens(joined)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def _with_bm25(docs: DataFrame, columns: list[str], query: str, k1: float, b: float) -> DataFrame:
    """The documents that hold all terms, with ``bm25``; all their columns stay, so nothing joins or shuffles texts.

    Only the query's terms are counted: no index is built for a query, and the corpus figures are one row.
    """
    terms = query_terms(query)
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    tf = {f"_tf{i}": F.regexp_count(text, F.lit(f"(?<![0-9a-z]){t}(?![0-9a-z])")) for i, t in enumerate(terms)}
    counted = docs.withColumns({"_dl": F.regexp_count(text, F.lit(TOKEN)), **tf})
    figures = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *_frequencies(terms))
    matched = counted.filter(" AND ".join(f"{c} > 0" for c in tf))
    return matched.crossJoin(F.broadcast(figures)).select(*docs.columns, _score(len(terms), k1, b).alias("bm25"))  # figures: one row


def _frequencies(terms: list[str]) -> list[Column]:
    return [F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))]


def _score(terms: int, k1: float, b: float) -> Column:
    """BM25 of _tf0.., _df0.., _dl, _n and _avgdl; lower is better."""
    score = F.lit(0.0)
    for i in range(terms):
        hits, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score - idf * hits * (k1 + 1) / (hits + k1 * (1 - b + b * F.col("_dl") / F.col("_avgdl")))
    return score


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, bm25) of documents that hold all terms; lower is better."""
    return _with_bm25(docs, columns, query, k1, b).select(key, "bm25")


def _matching(docs: DataFrame, columns: list[str], query: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    for t in query_terms(query):
        docs = docs.filter(text.rlike(f"(?<![0-9a-z]){t}(?![0-9a-z])"))
    return docs


def composite(bm25_score: Column, authority: Column, review_state: Column, confidence: Column) -> Column:
    """The rank that results sort by, least first."""
    level, state = F.lower(F.coalesce(authority, F.lit(""))), F.lower(F.coalesce(review_state, F.lit("")))
    bonus = lambda c, table: F.coalesce(lookup(c, table), F.lit(0.0))
    sure = F.when(confidence.isNull() | F.isnan(confidence) | (confidence < 0), 0.0).when(confidence > 1, 1.0).otherwise(confidence)
    return bm25_score * 0.95 + bonus(level, vocab.AUTHORITY_BONUS) + bonus(state, vocab.REVIEW_BONUS) + bonus(state, vocab.NEGATIVE_PENALTY) - sure * 0.75


SEARCHED = ["object_ref", "object_type", "title", "subtitle", "indexed_text"]


def _shown(projection: DataFrame, scope: str) -> DataFrame:
    return projection.filter("exclusion_reason IS NULL").filter(F.col("object_type").isin(vocab.SCOPES[scope]))


def search(projection: DataFrame, query: str, scope: str = "all", limit: int = 20, offset: int = 0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The page of best results with score, rank and snippet."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    hits = _with_bm25(_shown(projection, scope), SEARCHED, query, k1, b)
    scored = hits.withColumn("score", composite(F.col("bm25"), F.col("authority_level"), F.col("review_state"), F.col("confidence_score")))
    page = scored.orderBy("score", "object_type", "object_pk").offset(offset).limit(limit)
    return page.select("object_ref", "object_type", "result_class", "title", "score", snippet(F.col("indexed_text"), query_terms(query)).alias("snippet"))


def match_count(projection: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """(matches) of a query, without scores."""
    return _matching(_shown(projection, scope), SEARCHED, query).agg(F.count("*").alias("matches"))


class Index:
    """A stored inverted index of the searchable rows of a projection: queries read the postings of their terms alone.

    ``postings`` has a row for each term of each document with what ranking needs, in folders by a bucket of the term
    and sorted by term within files, so a scan skips other buckets by folder and other terms by row-group bounds.
    ``lengths`` has the number of documents and of words of each object type.  Ranges of (bucket, term, document)
    make the files, so a word that most documents hold is spread over many.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, projection: DataFrame) -> Index:
        """Write the index; an index is written once, into a new folder."""
        rows = projection.filter("exclusion_reason IS NULL")
        words = tokens(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in SEARCHED)))
        bonus = composite(F.lit(0.0), F.col("authority_level"), F.col("review_state"), F.col("confidence_score"))
        docs = rows.select("object_ref", "object_type", "object_pk", bonus.alias("bonus"), words.alias("words"))
        counted = docs.select("object_ref", "object_type", "object_pk", "bonus", F.size("words").alias("words"), F.explode("words").alias("term"))
        by_term = counted.groupBy("term", "object_type", "object_ref", "object_pk", "bonus", "words").agg(F.count("*").alias("tf"))
        placed = by_term.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(self.buckets)).cast("int"))
        sorted_ = placed.repartitionByRange("bucket", "term", "object_ref").sortWithinPartitions("bucket", "term", "object_ref")
        sorted_.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        docs.groupBy("object_type").agg(F.count("*").alias("documents"), F.sum(F.size("words")).alias("words")).write.parquet(f"{self.path}/lengths")
        return self

    def _counted(self, terms: list[str], scope: str) -> DataFrame:
        """A row for each document of the scope that holds a term, with _dl and a _tf of each term."""
        where = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        read = self.spark.read.parquet(f"{self.path}/postings")
        found = read.filter(F.col("bucket").isin(where) & F.col("term").isin(terms) & F.col("object_type").isin(vocab.SCOPES[scope]))
        tf = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
        return found.groupBy("object_ref", "object_type", "object_pk", "bonus", F.col("words").alias("_dl")).agg(*tf)

    def hits(self, query: str, scope: str = "all", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(object_ref, object_type, object_pk, bonus, bm25) of the documents that hold all terms."""
        terms = query_terms(query)
        counted = self._counted(terms, scope)
        lengths = self.spark.read.parquet(f"{self.path}/lengths").filter(F.col("object_type").isin(vocab.SCOPES[scope]))
        figures = lengths.agg(F.sum("documents").alias("_n"), (F.sum("words") / F.sum("documents")).alias("_avgdl"))
        figures = figures.crossJoin(F.broadcast(counted.agg(*_frequencies(terms))))  # one row each
        matched = counted.filter(" AND ".join(f"_tf{i} > 0" for i in range(len(terms))))
        return matched.crossJoin(F.broadcast(figures)).select("object_ref", "object_type", "object_pk", "bonus", _score(len(terms), k1, b).alias("bm25"))

    def search(self, projection: DataFrame, query: str, scope: str = "all", limit: int = 20, offset: int = 0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """What ``search`` gives; titles and snippets are read for the page's rows, at most 100."""
        if not 1 <= limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        scored = self.hits(query, scope, k1, b).withColumn("score", F.col("bm25") * 0.95 + F.col("bonus"))
        page = scored.orderBy("score", "object_type", "object_pk").offset(offset).limit(limit).select("object_ref", "score", "object_pk")
        shown = _shown(projection, scope).drop("score", "object_pk").join(F.broadcast(page), "object_ref")
        return shown.orderBy("score", "object_type", "object_pk").select("object_ref", "object_type", "result_class", "title", "score", snippet(F.col("indexed_text"), query_terms(query)).alias("snippet"))

    def match_count(self, query: str, scope: str = "all") -> DataFrame:
        """(matches) of a query, without scores."""
        terms = query_terms(query)
        return self._counted(terms, scope).filter(" AND ".join(f"_tf{i} > 0" for i in range(len(terms)))).agg(F.count("*").alias("matches"))


def with_truncation(page: DataFrame, limit: int) -> tuple[list, bool]:
    """The rows of a page fetched with one row over its limit, and whether that row was there."""
    rows = page.take(limit + 1)
    return rows[:limit], len(rows) > limit
