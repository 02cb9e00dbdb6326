"""Document and operational analytics expressed as Spark DataFrame plans."""
