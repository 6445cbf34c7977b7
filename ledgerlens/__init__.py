"""Case-record analytics on Spark."""
