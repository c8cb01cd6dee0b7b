"""Evidence integration, text curation and evaluation analytics expressed as Spark plans."""
