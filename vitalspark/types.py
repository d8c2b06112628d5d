"""Logical types of canonical columns and the Spark types that hold them."""

from __future__ import annotations

#: Logical type -> Spark type.
LOGICAL_TYPES = {
    "text": "string",
    "integer": "bigint",
    "numeric": "double",
    "boolean": "boolean",
    "timestamp": "timestamp",
    "jsonb": "variant",
    "string[]": "array<string>",
    "partial_date": "struct<year:int,month:int,day:int,precision:string>",
    "quantity_with_unit": "struct<value:double,unit:string,canonical_value:double,canonical_unit:string>",
    "coded_value": "struct<code:string,system:string,display:string>",
}
VERDICTS = ("join", "append", "unclear")

#: Append-only log of routing decisions.
DECISION = (
    "id string, workspace_key string, pkey string, source string, source_column string, source_data_type string, source_description string, "
    "source_samples array<string>, verdict string, canonical_name string, is_global_target boolean, similarity_score double, reason string, "
    "needs_review boolean, decided_by string, decided_at timestamp"
)
#: Canonical columns that a workspace's subject has.
SCHEMA_ROW = "id string, workspace_key string, pkey string, canonical_name string, data_type string, description string, is_global boolean, source_origin string, first_seen_at timestamp, updated_at timestamp"
#: One source record with its values by canonical name (JSON text of each).
SIGNAL = "id string, workspace_key string, pkey string, source string, external_id string, occurred_at string, columns map<string,string>, ingested_at timestamp"
#: A canonical column with its data dictionary.
DICTIONARY = "name string, data_type string, description string, semantic_tags array<string>, canonical_unit string, controlled_vocabulary string, analyte string, code_system string"
#: One value of a source record, before routing.
TALL = "workspace_key string, pkey string, source string, external_id string, occurred_at string, source_column string, value string, source_data_type string, source_description string"
