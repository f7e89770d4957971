"""Column expressions: every function takes column names or columns and returns a column, or a dict of
named columns for one ``withColumns``."""
