"""Shop-floor analytics as Spark DataFrame transformations."""
