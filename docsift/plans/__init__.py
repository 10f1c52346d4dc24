"""plans of docsift."""
