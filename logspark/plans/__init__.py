"""Whole scans, test-table adapters, the query catalogue and its SQL twins."""
