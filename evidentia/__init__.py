"""evidentia: evidence scoring and text analytics expressed as Spark DataFrame jobs."""
