"""parcelwise: return-to-origin (RTO) risk analytics for order tables on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL / Spark ML,
so the same plan runs on ``local[*]`` and on a cluster.
"""

__version__ = "0.1.0"
