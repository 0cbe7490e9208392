"""Whole validation runs and suites of runs."""
