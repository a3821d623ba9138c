"""All registered queries and their SQL, gathered from the modules of this folder."""

from quarry.plans import cases, corpus, evals, ingest, judged, market, runs, traces

QUERIES, ORACLE_SQL = {}, {}
for module in (market, corpus, runs, judged, ingest, cases, evals, traces):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
#: The query that ``entry`` runs.
FLAGSHIP = "rrf_hybrid"
