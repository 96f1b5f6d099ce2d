"""meterbook: batch and streaming jobs for subscriber billing books on Spark.

Every job is a function of DataFrames: it reads whole tables (or frames
Spark derives from them) and returns new DataFrames. Nothing is collected
to the driver; all work is expressed with built-in Spark expressions so it
stays inside whole-stage codegen and scales with the cluster.
"""

__version__ = "0.1.0"
