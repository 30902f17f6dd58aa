"""Registered queries: importing this package fills base.QUERIES and base.ORACLES."""

from . import alignment, contracts, files, inventories, scalars, schedules, scores, selections, sequences, statistics, streams, tables  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
