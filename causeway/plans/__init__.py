"""Plan builders: patterns, traversals, projection."""
