"""operators of docsift."""
