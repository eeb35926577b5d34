"""Sources and sinks."""

from .config import CodeRule, Config, expand_code, load_config, parse_config
from .defaults import default_config
from .sinks import extract_tables, load_splits, save_splits, write_report, write_result
from .tables import Tables, inventory, only_items, read_table, table_path

__all__ = [
    "CodeRule",
    "Config",
    "Tables",
    "default_config",
    "expand_code",
    "extract_tables",
    "inventory",
    "load_config",
    "load_splits",
    "only_items",
    "parse_config",
    "read_table",
    "save_splits",
    "table_path",
    "write_report",
    "write_result",
]
