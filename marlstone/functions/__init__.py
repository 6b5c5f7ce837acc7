"""Column functions and small helpers shared by the operators."""
