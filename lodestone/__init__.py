"""lodestone: evidence, findings and text analytics expressed as Spark plans."""
