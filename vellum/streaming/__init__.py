"""The same tables over a stream of arriving files."""
