"""summarium: summarization-corpus preparation and summary evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (or a Column builder)
expressed with Spark SQL built-ins; Arrow-batched pandas UDFs are used only for
the two per-row kernels Spark has no built-in for (LCS length, Porter stem).
"""

__version__ = "0.1.0"
