"""airlag: flight on-time analytics and delay modelling on Spark.

Every operator is a function from DataFrame(s) to a DataFrame built with the
DataFrame API, so Catalyst plans it and it runs unchanged from local mode to a
cluster.  Sub-packages:

* ``sources``   - driver tables, monthly CSV ingest, stage/summary/report sinks
* ``functions`` - column expressions (calendar, targets, hashing, null counts)
* ``operators`` - cleaning, features, profiling, plot data, ordering, splits,
                  balancing, metrics
* ``plans``     - pipelines, estimators, tuning, the query catalog
* ``streaming`` - incremental ingest of monthly CSV drops
"""

__version__ = "0.1.0"
