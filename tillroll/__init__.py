"""tillroll: retail basket analytics as Spark DataFrame jobs."""
