"""Invoice audit analytics as Spark DataFrame transformations."""
