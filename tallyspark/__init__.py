"""Purchase-choice analytics as Spark DataFrame plans."""
