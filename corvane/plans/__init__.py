"""Whole plans above the operators; importing this package registers their queries beside the catalog's."""

from corvane.plans import decisions, expansion, funnel, groups, hybrid, ingest, judgments, measures, refresh, reports, scenarios, training, understanding  # noqa: F401
