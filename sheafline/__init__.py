"""Document analytics, evaluation statistics and corpus operators on PySpark."""
