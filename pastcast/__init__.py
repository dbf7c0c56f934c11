"""pastcast — point-in-time (leak-free) event-history features, splits,
metrics, profiling and scoring, expressed as Spark DataFrame plans.

Subpackages
-----------
sources    readers/writers and the bindings to the test tables
functions  scalar Column expressions (names, numbers, dates, times)
operators  relational building blocks (as-of state join, grids, splits, metrics)
ml         Spark ML model training, scoring and explanation
plans      the query catalogue registered with the driver (+ DuckDB oracles)
streaming  Structured Streaming variants of landing, dedup and scoring
"""

__version__ = "0.1.0"
