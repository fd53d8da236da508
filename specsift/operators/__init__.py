"""DataFrame -> DataFrame operators (joins, aggregates, top-k, scorers)."""
