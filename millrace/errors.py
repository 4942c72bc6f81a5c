"""Errors that a statement or an operator call can raise."""


class QueryError(ValueError):
    """A statement that can't be read, bound or typed."""
