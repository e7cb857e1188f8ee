"""Source text to facts: symbols, call sites and imports of a file."""
