"""Column-level helpers: everything here builds Spark columns or scalar tails."""
