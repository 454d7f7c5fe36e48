"""limnos — Spark-native water-quality analytics.

Every operator is a function ``DataFrame -> DataFrame`` (use with
``df.transform``) or a ``Column`` builder.  Row-local work stays inside
whole-stage codegen; cross-row work is expressed as aggregations, broadcast
joins of provably small dimensions, and Structured Streaming state.
"""

__version__ = "0.1.0"
