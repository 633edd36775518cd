"""rinkspark: league analytics as Spark DataFrame jobs.

Packages:
    functions  - scalar column expressions (scoring, calendar, names)
    operators  - DataFrame -> DataFrame operators (analysis, dimension,
                 calendar, roster moves, features, joins)
    sources    - landed JSON / CSV readers, table store and upserts, ingest
    plans      - the registered queries over the supplied test tables
    streaming  - incremental fact load and idempotent totals
"""

__version__ = "0.1.0"
