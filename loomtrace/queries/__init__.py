"""Registered queries of the workflow engine and their SQL twins."""

from loomtrace.queries import governance, joins, logs, reports, scalars, scores, sources, stores, streams, workflows

_MODULES = (logs, scalars, scores, joins, governance, workflows, reports, sources, stores, streams)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
