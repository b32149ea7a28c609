"""Column layouts shared by all operators."""

OWNER = "owner_id"
PACK_KEYS = ["owner_id", "pack"]

FACTS = (
    "owner_id string, pack string, pos bigint, key string, value_items array<string>, "
    "value_is_list boolean, type string, confidence string, source string, updated_at timestamp_ntz"
)
RULES = "owner_id string, pack string, pos bigint, instruction string, priority int"
PACKS = (
    "owner_id string, pack string, scope string, schema_version string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, description string, tags array<string>"
)
USAGE_LOG = "event_id bigint, owner_id string, ts timestamp_ntz, pack string, key string, agent string"
MESSAGES = "owner_id string, conv_id string, pos bigint, text string"

# The closed vocabularies of the data model.
FACT_TYPES = ["preference", "identity", "skill", "style", "constraint", "context"]
CONFIDENCES = ["high", "medium", "low"]
