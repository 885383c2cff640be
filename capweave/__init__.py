"""capweave: equity-register analytics expressed as Spark DataFrame transformations."""
