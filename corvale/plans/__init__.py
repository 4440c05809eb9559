"""Plans made of several operators: ingest, index catalog, search service."""
