"""All queries of the core, and their SQL."""

from turnledger.plans import captures, contracts, evidence, lineage, measures, training

_PARTS = (lineage, contracts, training, measures, evidence, captures)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
