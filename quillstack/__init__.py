"""Document-knowledge analytics expressed as Spark DataFrame transformations."""
