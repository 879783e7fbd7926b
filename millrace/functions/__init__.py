"""Column functions and small plan helpers shared by the operators."""
