"""Errors of the log facade."""


class LogError(Exception):
    """The log is closed, or an operation isn't possible in its state."""


class LogBusyError(LogError):
    """Maintenance is behind; the write was accepted all the same."""
