"""doclattice: document-graph analytics expressed as Spark DataFrame plans."""
