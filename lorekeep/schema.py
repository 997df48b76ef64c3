"""Fixed table schemas; reads never infer them."""

from __future__ import annotations

LINKS = "array<struct<anchor:string,target:string,reason:string>>"
RELATIONS = "array<struct<source:string,relation:string,target:string,confidence:double>>"
SOURCES = (
    "array<struct<raw_path:string,normalized_path:string,locator:string,source_hash:string,"
    "supported_claims:array<string>>>"
)
SECTIONS = "array<struct<key:string,value:string>>"

NOTES = (
    "note_id string, title string, aliases array<string>, folder string, tags array<string>, "
    f"summary string, retrieval_text string, body_sections {SECTIONS}, proposed_links {LINKS}, "
    f"relations {RELATIONS}, sources {SOURCES}, confidence double, created_at timestamp, "
    "updated_at timestamp"
)
# What a text column holds when a record misses it.
NOTE_DEFAULTS = {
    "aliases": "cast(array() as array<string>)",
    "folder": "''",
    "tags": "cast(array() as array<string>)",
    "summary": "''",
    "retrieval_text": "''",
    "body_sections": f"cast(array() as {SECTIONS})",
    "proposed_links": f"cast(array() as {LINKS})",
    "relations": f"cast(array() as {RELATIONS})",
    "sources": f"cast(array() as {SOURCES})",
    "confidence": "0.8D",
}

CLAIMS = (
    "claim_id string, note_id string, text string, evidence string, confidence double, "
    "valid_from timestamp, valid_to timestamp, observed_at timestamp, source_time timestamp, "
    "transaction_from timestamp, transaction_to timestamp, invalidated_by string, detail string"
)
CLAIM_TIMES = (
    "valid_from", "valid_to", "observed_at", "source_time", "transaction_from", "transaction_to",
)
TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".rst", ".html", ".htm")
