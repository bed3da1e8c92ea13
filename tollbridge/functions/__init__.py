"""Column helpers made of built-in Spark functions only."""
