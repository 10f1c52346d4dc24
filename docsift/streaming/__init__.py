"""streaming of docsift."""
