"""Sources and sinks: landing CSV, layer tables and paths, test fixtures."""

from tierloom.sources.landing import EmptyLandingError, read_raw
from tierloom.sources.layers import (
    NotALayerError,
    SchemaMismatchError,
    layer_bytes,
    read_layer,
    read_table,
    table_bytes,
    table_format,
    write_layer,
    write_table,
)

__all__ = [
    "EmptyLandingError",
    "NotALayerError",
    "SchemaMismatchError",
    "layer_bytes",
    "read_layer",
    "read_raw",
    "read_table",
    "table_bytes",
    "table_format",
    "write_layer",
    "write_table",
]
