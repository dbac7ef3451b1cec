"""Models on spark.ml and their metrics as plain aggregations."""
