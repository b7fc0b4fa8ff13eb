"""Product-search dataset building and ranking evaluation as Spark DataFrame jobs."""
