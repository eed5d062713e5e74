"""DataFrame operators: profiling, cleaning, joining, features, KPIs, charts,
significance, confounding, attribution, comparison, claims, grounding, domain
and ledger tables."""
