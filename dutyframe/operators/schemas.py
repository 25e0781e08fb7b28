"""The tables of the record model. Civil times are timestamp_ntz, instants timestamp."""

ENTITY = "id long, kind string, name string, name_folded string, address string, municipality string, lat double, lon double, url string, phone string, created_at timestamp, updated_at timestamp, location_source string"
ENTITY_ALIAS = "entity_id long, alias string, alias_folded string"
ENTITY_EXTERNAL_ID = "entity_id long, scheme string, value string"
SNAPSHOT = "id long, source_id string, url string, sha256 string, fetched_at timestamp, published_date date, revision int, label string"
PROCESSED = "snapshot_id long, processed_at timestamp"
PROPERTY = "entity_id long, snapshot_id long, kind string, on_date date, starts_at timestamp_ntz, ends_at timestamp_ntz, payload string"
ISSUE = "snapshot_id long, source_id string, severity string, code string, detail string, created_at timestamp"
TABLES = {"entity": ENTITY, "entity_alias": ENTITY_ALIAS, "entity_external_id": ENTITY_EXTERNAL_ID, "snapshot": SNAPSHOT, "processed": PROCESSED, "property": PROPERTY, "ingest_issue": ISSUE}

# Domains of the kinds, groups and severities.
KINDS = ["pharmacy", "hospital", "health_centre", "cinema", "film"]
GROUPS = ["pharmacies", "hospitals", "cinemas"]
SEVERITIES = ["error", "warning", "info"]
