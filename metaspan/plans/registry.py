"""All queries over the driver tables that do not belong to the training-data operators."""

from __future__ import annotations

from metaspan.plans import columns, exchange, relations, reports

QUERIES: dict = {**columns.QUERIES, **relations.QUERIES, **reports.QUERIES, **exchange.QUERIES}
ORACLES: dict[str, str] = {**columns.ORACLES, **relations.ORACLES, **reports.ORACLES, **exchange.ORACLES}
