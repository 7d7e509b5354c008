"""Composed plans: test-data bindings, the query catalogue and the five-step run."""
