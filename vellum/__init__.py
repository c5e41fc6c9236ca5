"""Analytics over collections of documents with Spark."""
