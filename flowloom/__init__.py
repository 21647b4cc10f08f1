"""Flow analytics and corpus preparation on Spark."""
