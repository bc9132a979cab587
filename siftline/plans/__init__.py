"""Registered queries, their fixtures and SQL, and the composed search plan."""
