"""Claims governance, audit and analytics as Spark DataFrame transformations."""
