"""functions of docsift."""
