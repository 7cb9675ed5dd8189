"""tidemark: versioned, interval-shaped event analytics expressed as Spark plans."""
