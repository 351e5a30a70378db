"""Errors of the engine, by what went wrong."""


class QuernError(Exception):
    """Base of all errors raised on purpose."""


class PlanningError(QuernError):
    """The query can't be given a meaning: unknown or ambiguous names, types that do not fit."""


class AmbiguousNameError(PlanningError):
    """A name fits more than one column."""


class UnsupportedError(QuernError):
    """The query is valid SQL but outside the accepted subset."""


class NotFoundError(QuernError):
    """No table of that name is registered."""


class ExecutionError(QuernError):
    """A plan failed while running, such as by integer overflow or division by zero."""


class ResourceExhaustedError(QuernError):
    """A result is larger than the session's memory limit."""


class CancelledError(QuernError):
    """The query was cancelled through its token."""
