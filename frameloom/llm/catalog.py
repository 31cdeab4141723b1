"""All queries of the training-data operators, by name, and their SQL equivalents."""

from frameloom.llm import review_problems, text_problems

_MODULES = (review_problems, text_problems)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
