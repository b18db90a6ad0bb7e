"""The table API: shaping, aggregation, joins, windows."""

from tessera.operators.joins import DuplicateKeys
from tessera.operators.table import Table

__all__ = ["DuplicateKeys", "Table"]
