"""sources of docsift."""
