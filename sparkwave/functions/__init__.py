"""Column functions. None of them looks at a row from Python."""
