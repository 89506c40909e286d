"""State and graph operators: pure functions from tables to tables."""
