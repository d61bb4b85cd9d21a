"""Near-duplicate and event-clustering analytics, written as Spark DataFrame plans."""
