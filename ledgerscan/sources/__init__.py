"""Reading files into string tables, cleaning their schema, and writing results."""

from ledgerscan.sources.readers import read_any, read_csv, read_json, read_parquet, read_xml
from ledgerscan.sources.schema import fill_defaults, infer_types, make_unique, type_labels, value_index
from ledgerscan.sources.sinks import save, write

__all__ = [
    "fill_defaults",
    "infer_types",
    "make_unique",
    "read_any",
    "read_csv",
    "read_json",
    "read_parquet",
    "read_xml",
    "save",
    "type_labels",
    "value_index",
    "write",
]
