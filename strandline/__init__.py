"""Pattern analytics on Spark: structure-finding operators over DataFrames."""

__version__ = "0.1.0"
