"""Table layouts. A list in a service description becomes rows with an explicit ordinal column."""

from __future__ import annotations

FIELDS_DDL = ("service STRING, entity STRING, field_ord BIGINT, name STRING, json_name STRING, type STRING, "
              "source_type STRING, optional BOOLEAN")
ENTITIES_DDL = ("service STRING, entity_ord BIGINT, entity STRING, kind STRING, file STRING, line INT, "
                "`values` ARRAY<STRING>")
ENDPOINTS_DDL = ("service STRING, ep_ord BIGINT, method STRING, path STRING, handler STRING, returns STRING, "
                 "file STRING, line INT")
PARAMS_DDL = "service STRING, ep_ord BIGINT, param_ord INT, name STRING, location STRING, type STRING"
SERVICES_DDL = "service STRING, language STRING, framework STRING, root STRING, port INT"
TOOL_RUNS_DDL = "tool STRING, installed BOOLEAN, returncode INT, stdout STRING, stderr STRING"

# One service as the nested JSON document that is exchanged with other tools.
SERVICE_JSON_DDL = (
    "name STRING, language STRING, framework STRING, root STRING, port INT, "
    "entities ARRAY<STRUCT<name: STRING, fields: ARRAY<STRUCT<name: STRING, json_name: STRING, type: STRING, "
    "source_type: STRING, optional: BOOLEAN>>, file: STRING, line: INT, kind: STRING, `values`: ARRAY<STRING>>>, "
    "endpoints ARRAY<STRUCT<method: STRING, path: STRING, handler: STRING, returns: STRING, "
    "params: ARRAY<STRUCT<name: STRING, location: STRING, type: STRING>>, file: STRING, line: INT>>"
)
