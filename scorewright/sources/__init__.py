"""Reading, writing and deriving the input tables."""
