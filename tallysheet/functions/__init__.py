"""Column expressions: pure functions of columns, all built in but for Unicode composition."""
