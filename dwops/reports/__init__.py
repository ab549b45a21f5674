"""The registered reports: each a Spark query with, where SQL can say it, its SQL twin."""

from dwops.reports import aggregates, checks, hierarchies, joins, loads, scalars, scans, search, streams, windows  # noqa: F401
from dwops.reports.registry import REPORTS, report

__all__ = ["REPORTS", "report"]
