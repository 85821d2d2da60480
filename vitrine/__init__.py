"""vitrine: retail signal analytics as declarative Spark plans."""
