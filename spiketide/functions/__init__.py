"""Column functions: no rows move."""
