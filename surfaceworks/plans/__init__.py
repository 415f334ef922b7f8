"""Queries of the reference's operators over the test tables."""

from . import queries as _queries  # noqa: F401
from . import records as _records  # noqa: F401
from . import surfaces as _surfaces  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
