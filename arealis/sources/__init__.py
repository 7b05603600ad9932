"""Reading tables and writing result rows."""

from arealis.sources.json_rows import explode_json_objects, from_json_rows, to_json_rows, write_json_rows
from arealis.sources.tables import RESOLUTIONS, load, stats_table

__all__ = [
    "RESOLUTIONS",
    "explode_json_objects",
    "from_json_rows",
    "load",
    "stats_table",
    "to_json_rows",
    "write_json_rows",
]
