from ordermart.sources.files import (
    json_rejects,
    list_objects,
    read_json,
    read_json_any,
    read_table,
    read_tables,
    table_objects,
)

__all__ = [
    "json_rejects",
    "list_objects",
    "read_json",
    "read_json_any",
    "read_table",
    "read_tables",
    "table_objects",
]
