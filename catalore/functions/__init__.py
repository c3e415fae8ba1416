"""Column expressions: every function takes and returns Columns, nothing runs in Python."""
