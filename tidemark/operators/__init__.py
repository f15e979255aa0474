"""Query operators: ingest, search, facets, enrichment."""
