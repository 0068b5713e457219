"""Closed vocabularies and constants of the store's contract (fixed values)."""

REVIEW_STATES = ["accepted", "ambiguous", "approved", "curated", "demoted", "deprecated", "machine_extracted", "needs_review", "proposed", "recorded", "rejected", "reviewed", "unreviewed"]
ESTABLISHED = ["accepted", "approved", "curated", "reviewed"]
LEADS = ["machine_extracted", "needs_review", "proposed", "recorded", "unreviewed"]
EXCLUDED = ["demoted", "deprecated", "rejected"]

#: The sets differ by purpose and are passed in, never shared.
FEEDBACK_LEADS = ["ambiguous", "machine_extracted", "needs_review", "proposed", "recorded", "unreviewed"]
HEALTH_PENDING = ["", "ambiguous", "machine_extracted", "needs_review", "proposed", "unreviewed"]
HEALTH_RESOLVED = ["accepted", "approved", "curated", "demoted", "deprecated", "rejected", "reviewed"]
SATURATION_REVIEWABLE = ["ambiguous", "machine_extracted", "needs_review", "proposed", "unreviewed"]

PUBLICATION_STATES = ["blocked", "local_only", "private_working", "public_preview", "public_release_allowed", "public_release_candidate"]
PUBLIC_STATES = ["public_preview", "public_release_allowed", "public_release_candidate"]
PUBLICATION_ALIASES = {"draft": "private_working", "previewable": "public_preview", "public_safe": "public_release_allowed", "published": "public_release_allowed"}

RESULT_CLASS = {
    "authority": "entity",
    "claim": "claim",
    "controlled_subject": "facet",
    "provenance_event": "event",
    "relationship": "relationship",
    "source_access": "source",
    "topic_extension": "facet",
    "work": "work",
}
SCOPES = {
    "all": sorted(RESULT_CLASS),
    "source_work": ["source_access", "work"],
    "authority": ["authority"],
    "controlled_subject": ["controlled_subject"],
    "source_access": ["source_access"],
    "relationship": ["relationship"],
    "claim": ["claim"],
    "provenance_event": ["provenance_event"],
    "topic_extension": ["topic_extension"],
}
PROFILES = ["local", "public_preview", "public_release"]

AUTHORITY_BONUS = {"primary": -0.35, "trusted": -0.20, "approved": -0.15, "secondary": -0.10}
REVIEW_BONUS = {"approved": -0.10, "curated": -0.05, "reviewed": -0.03}
NEGATIVE_PENALTY = {"rejected": 2.0, "deprecated": 2.0, "demoted": 2.0}

FAMILY_WEIGHTS = {
    "accepted_record": 2.0,
    "authority_reconciliation": 1.0,
    "capture_event": 0.5,
    "extraction_detected_entity": 1.0,
    "extraction_record": 0.5,
    "reviewable_record": 1.0,
    "source_access": 1.0,
    "source_claim": 1.0,
    "source_relationship": 1.0,
    "work": 1.0,
}
SCORING_WEIGHTS = {
    "productive_run": 3.0,
    "open_lead": 2.5,
    "work_yield": 2.0,
    "claim_yield": 1.5,
    "entity_yield": 1.5,
    "relationship_yield": 1.0,
    "successful_extraction": 1.25,
    "failed_extraction_penalty": 1.5,
    "zero_yield_penalty": 2.0,
    "recent_low_yield_penalty": 1.0,
    "bootstrap_bias": 0.25,
}
EXTRACTION_SUCCESS = ["completed", "ok", "recorded", "success"]
EXTRACTION_FAILURE = ["bad_utf8", "error", "failed", "hostile_replay", "invalid"]
ENTITY_FACETS = {
    "person": "people",
    "person_or_group": "people",
    "place": "places",
    "organization": "organizations",
    "org": "organizations",
    "work": "works",
    "event": "events",
    "concept": "concepts",
    "topic": "topics",
    "product": "products",
}
QUESTION_TERMS = ["how", "what", "when", "where", "whether", "which", "who", "whom", "whose", "why"]
CONFIDENCE_BANDS = [(0.25, "very_low"), (0.5, "low"), (0.75, "medium"), (0.9, "high")]
IDENTIFIER_SCHEMES = ["doi", "isbn", "issn", "orcid", "wikidata", "url", "http", "https", "local"]
