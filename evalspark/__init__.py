"""evalspark — table-scale evaluation of text/LLM outputs and of the logs around them, on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from Spark
expressions; Arrow (pandas) UDFs appear only where no built-in exists.
"""

__version__ = "0.1.0"
