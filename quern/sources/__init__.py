"""Reading and writing tables."""

from quern.sources.tables import json_rows, read_table, read_tables, register_folder, shared_folder, write_table

__all__ = ["json_rows", "read_table", "read_tables", "register_folder", "shared_folder", "write_table"]
