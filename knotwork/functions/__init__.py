"""Column functions and, where Spark has none, Arrow functions."""
