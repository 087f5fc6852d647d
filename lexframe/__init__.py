"""lexframe: DataFrame operators for a legislative text corpus on Spark.

Every public operator takes DataFrames and returns DataFrames; nothing is
collected to the driver.  Sub-packages:

* ``functions``  column expressions (patterns, text, urls, json)
* ``sources``    readers (JSONL, HTML trees, text files) and stand-in views
* ``operators``  shredding, classification, hierarchy, lookups, vectors, evals
* ``sinks``      write-once, upsert, replace, rating updates (staging + swap)
* ``plans``      registered queries and their DuckDB oracle SQL
* ``streaming``  incremental ingest with ``foreachBatch``
"""

__version__ = "0.1.0"
