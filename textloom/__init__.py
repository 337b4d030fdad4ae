"""Text analytics and corpus preparation as Spark DataFrame transformations."""
