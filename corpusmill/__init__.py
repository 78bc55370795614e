"""corpusmill: set-at-a-time corpus preparation, retrieval and evaluation jobs on Spark."""
