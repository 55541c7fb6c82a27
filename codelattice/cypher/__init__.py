"""A bounded, read-only graph pattern language: text to syntax tree to DataFrame plan."""
