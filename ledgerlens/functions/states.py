"""Review and publication states, visibility and other predicates as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def lookup(column: Column, table: dict) -> Column:
    """The mapped value, or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column] if table else F.lit(None)


def first_nonblank(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string"))) for c in columns))


def blank_bucket(column: Column, name: str = "[blank]") -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(name))


def publication_state(column: Column) -> Column:
    """Normal form of a publication state; unknown ones are local only."""
    low = F.lower(F.trim(column))
    named = F.coalesce(lookup(low, vocab.PUBLICATION_ALIASES), low)
    return F.when(named.isin(vocab.PUBLICATION_STATES), named).otherwise(F.lit("local_only"))


def is_searchable(review_state: Column) -> Column:
    return F.coalesce(F.lower(F.trim(review_state)).isin(vocab.ESTABLISHED), F.lit(False))


def blocked(blocker: Column) -> Column:
    return F.coalesce(F.trim(blocker) != "", F.lit(False))


def is_public(review_state: Column, publication: Column, blocker: Column) -> Column:
    """Strict: searchable review state, no blocker and a public state."""
    return is_searchable(review_state) & ~blocked(blocker) & publication_state(publication).isin(vocab.PUBLIC_STATES)


def is_public_lenient(publication: Column, blocker: Column) -> Column:
    """For exports: no blocker, and a public state if one is given."""
    return ~blocked(blocker) & (publication.isNull() | publication_state(publication).isin(vocab.PUBLIC_STATES))


def visible_profiles(publication: Column, blocker: Column, lineage: Column) -> Column:
    """The profiles that may show a row, as an array."""
    state = publication_state(publication)
    local = F.array(F.lit("local"))
    return (
        F.when(blocked(blocker) | (lineage == "superseded"), local)
        .when(state == "public_release_allowed", F.array(*map(F.lit, vocab.PROFILES)))
        .when(state.isin("public_preview", "public_release_candidate"), F.array(F.lit("local"), F.lit("public_preview")))
        .otherwise(local)
    )


def exclusion_reason(pk: Column, review_state: Column, publication: Column, blocker: Column, lineage: Column, indexed: Column, public: bool) -> Column:
    """Why a row is not in a search projection, or null; the first reason that holds."""
    out = F.when(pk.isNull(), "missing_pk").when(~is_searchable(review_state), "review_state_not_searchable")
    if public:
        out = (
            out.when(lineage == "superseded", "superseded_in_public_profile")
            .when(blocked(blocker), "public_blocker")
            .when(~publication_state(publication).isin(vocab.PUBLIC_STATES), "publication_state_not_public")
        )
    return out.when(F.coalesce(F.trim(indexed), F.lit("")) == "", "no_indexable_fields")


def pending(review_state: Column, wanted: str | None = None) -> Column:
    """The review queue's filter: not established by default, all, or one state."""
    if wanted == "all":
        return F.lit(True)
    if wanted:
        return F.coalesce(review_state, F.lit("")) == wanted
    return ~F.coalesce(review_state, F.lit("")).isin(vocab.ESTABLISHED)


def public_blocker(blocker: Column, flag: Column, publication: Column) -> Column:
    """The blocker, else its flag, else a blocking publication state."""
    return F.coalesce(F.nullif(F.trim(blocker), F.lit("")), F.when(flag, "public_blocked"), F.when(publication == "blocked", "publication_blocked"))


def state_label(review_state: Column, confidence: Column, noun: str, threshold: float = 0.8) -> Column:
    return (
        F.when(review_state.isin(vocab.ESTABLISHED), f"{noun} context")
        .when(F.coalesce(confidence, F.lit(-1.0)) >= threshold, f"high-confidence {noun} lead")
        .otherwise(f"{noun} lead")
    )


def extraction_outcome(status: Column) -> Column:
    """success, failed or neutral; an unknown status counts as failed."""
    low = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(low.isin(vocab.EXTRACTION_SUCCESS), "success").when(low == "", "neutral").otherwise("failed")


def is_open_question(claim_text: Column, claim_type: Column) -> Column:
    return F.coalesce(F.lower(claim_type).contains("question"), F.lit(False)) | F.coalesce(claim_text.contains("?"), F.lit(False))


def locator_label(*candidates: Column) -> Column:
    """A locator that may be shown: web addresses first, then the last candidate as a hint."""
    *urls, hint = candidates
    return F.coalesce(*(F.when(u.rlike("^https?://"), u) for u in urls), F.nullif(F.trim(hint), F.lit("")), F.lit("[internal locator withheld]"))


def merge_review_state(old: Column, new: Column, pending_states: Sequence[str] = tuple(vocab.LEADS)) -> Column:
    """A pending state never overwrites a state that is not."""
    return F.when(old.isNull(), new).when(new.isNull(), old).when(~old.isin(*pending_states) & new.isin(*pending_states), old).otherwise(new)


def keeps_envelope(old: Column, new: Column, pending_states: Sequence[str] = tuple(vocab.LEADS)) -> Column:
    """Whether an upsert leaves the old confidence, provenance, publication, authority and blocker."""
    old_pending, new_pending = old.isin(*pending_states), new.isin(*pending_states)
    established = old.isin(vocab.ESTABLISHED)
    return F.coalesce((~old_pending & new_pending) | (established & (new.isin(vocab.ESTABLISHED) | new_pending)), F.lit(False))


def entity_facet_prefilter(entity_type: Column, facets: Sequence[str]) -> Column:
    """The facet for filtering: a mapped type, else the first facet."""
    return F.coalesce(lookup(F.lower(F.replace(entity_type, F.lit(" "), F.lit("_"))), vocab.ENTITY_FACETS), F.lit(facets[0]))


def entity_facet(entity_type: Column, facets: Sequence[str]) -> Column:
    """The facet that a type is shown under: mapped, plural or singular, then sources, then the first."""
    low = F.replace(F.lower(F.trim(F.coalesce(entity_type, F.lit("")))), F.lit(" "), F.lit("_"))
    single = F.regexp_replace(low, "s$", "")
    named = F.coalesce(lookup(low, vocab.ENTITY_FACETS), F.when(low.endswith("s"), F.coalesce(lookup(single, vocab.ENTITY_FACETS), single)), low)
    has = lambda c: c.isin(*facets)
    plural, singular = F.concat(named, F.lit("s")), F.regexp_replace(named, "s$", "")
    last = F.lit("sources" if "sources" in facets else facets[0])
    return F.when(has(named), named).when((named != "") & has(plural), plural).when(named.endswith("s") & has(singular), singular).otherwise(last)
