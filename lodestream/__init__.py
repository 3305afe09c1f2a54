"""lodestream: session transcripts to curated knowledge and training text, as Spark DataFrame operators."""
