"""Schemas of the engine's tables, as DDL."""

#: A row of a corpus dump.
RAW = "id string, title string, type string, content string"
#: An extraction's lists; a chunk's extraction is (chunk_id, events, entities).
EVENTS = "array<struct<event_id:string,summary:string,actor:string,action:string,modality:string,trigger:string,source_span:string>>"
ENTITIES = "array<struct<name:string,type:string,aliases:array<string>>>"
EXTRACTION = f"chunk_id string, events {EVENTS}, entities {ENTITIES}"
ORG = "org_id string, canonical_name string, aliases array<string>, entity_type string, tax_id string, status string"
