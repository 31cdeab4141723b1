"""All queries of the core, by name, and their SQL equivalents."""

from frameloom.queries import captures, catalogue, changes, core_problems, export_plans, exports, history, imports, quality, rasters, review, sampling, similarity, sources, tiles

_MODULES = (core_problems, sources, sampling, tiles, quality, similarity, exports, changes, review, history, imports, export_plans, catalogue, rasters, captures)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
