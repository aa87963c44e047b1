"""Decision analytics expressed as Spark plans."""
