"""Errors of patterns and matching."""


class PatternError(ValueError):
    """A pattern, or a reference in a replacement, is invalid."""


class StepLimitError(PatternError):
    """A search took more steps, or nested calls deeper, than allowed."""
