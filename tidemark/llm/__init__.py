"""Training-data operators: whole-corpus jobs on Spark.  Nothing outside this package imports it."""
