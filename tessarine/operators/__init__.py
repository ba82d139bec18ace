"""DataFrame operators: records, blocking, comparison, estimation, clustering, metrics, review."""
