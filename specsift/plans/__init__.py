"""User-level composite jobs (search, build, maintenance, audit, graph, evaluation)."""
