"""Importing this package fills the query catalog."""

from helpdeck.plans import changes, lists, notify, quality, reports, streams  # noqa: F401
from helpdeck.plans.catalog import ORACLES, QUERIES  # noqa: F401
