"""Operators that prepare training corpora; nothing else in docsift imports this subpackage."""
