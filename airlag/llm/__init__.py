"""Operators for training-data pipelines on Spark.

One module per operator; ``catalog`` registers their queries.  Nothing outside
this subpackage imports it, and it uses only the general helpers of
``airlag.session``.
"""
