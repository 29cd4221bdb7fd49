"""Named queries over the driver's tables, with the SQL that has to give the same rows."""

from . import features, files, models, preparation, streams  # noqa: F401  (they register queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
