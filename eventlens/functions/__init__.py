"""Column functions: field tokens, time parts, identity, cleaning, statistics."""
