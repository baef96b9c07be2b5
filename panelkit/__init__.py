"""panelkit: Spark-native analytics for wide, drifting geography x period panels.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` expressions, joins, aggregates and windows (plus
``pyspark.ml`` for PCA / KMeans).  No Python UDF is used on any data path.
"""

__version__ = "0.1.0"
