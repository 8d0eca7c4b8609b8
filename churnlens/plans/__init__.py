"""Composed plans: the analytic view, integrity checks, the query registry."""
