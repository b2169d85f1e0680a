"""Code-graph analytics expressed as Spark plans."""
