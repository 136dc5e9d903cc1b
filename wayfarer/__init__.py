"""Transit analytics and corpus processing on Spark."""
