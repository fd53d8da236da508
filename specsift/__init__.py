"""specsift: declaration search and redundancy audit as Spark jobs.

Every public function takes and returns DataFrames and stays lazy; the
only driver-side work is the bounded collection of a query matrix that is
broadcast to executors (see ``operators.vectors``).
"""

__version__ = "0.1.0"
