"""factweave: page-consistency analytics expressed as Spark DataFrame plans."""
