"""Registered queries and the signals that they run over."""

from leafworks.plans import contents, queries, records  # noqa: F401  they register their queries
