"""All queries and their SQL twins, by name."""

from .plans import curve_queries, decision_queries, effect_queries, evaluation_queries, law_queries, learner_queries, ledger_queries, prep_queries, source_queries

GROUPS = (curve_queries, law_queries, effect_queries, ledger_queries, decision_queries, prep_queries, source_queries, learner_queries, evaluation_queries)
QUERIES = {k: f for g in GROUPS for k, f in g.QUERIES.items()}
ORACLES = {k: s for g in GROUPS for k, s in g.ORACLES.items()}
