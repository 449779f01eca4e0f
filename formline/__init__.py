"""formline: head-to-head match analytics as Spark jobs."""
