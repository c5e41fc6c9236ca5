"""DataFrame tables over collections of documents, and the relational kernels."""
