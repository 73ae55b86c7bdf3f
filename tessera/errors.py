"""Errors a user can act on, and warnings."""


class TesseraError(ValueError):
    """Raised when the input or the settings cannot give a meaningful result."""


class LeakWarning(UserWarning):
    """Rows that a model was fitted on turn up where it is judged."""
