"""What can go wrong with a question, and the exit status that says so."""

from __future__ import annotations

# Exit statuses.
OK, NOTHING, USAGE, ARCHIVE, TOO_LARGE, WRITE, TOOL, INTERNAL = range(8)


class Failure(Exception):
    """A failure a caller can tell from others by ``status``."""

    status = INTERNAL


class UsageError(Failure, ValueError):
    status = USAGE


class ArchiveError(Failure, LookupError):
    status = ARCHIVE


class WriteError(Failure, OSError):
    status = WRITE


class ToolError(Failure, RuntimeError):
    status = TOOL


def exit_status(outcome: object) -> int:
    """The status of an answer (nothing found is a status too) or of an exception."""
    from ..functions.render import OutputTooLarge

    if isinstance(outcome, OutputTooLarge):
        return TOO_LARGE
    if isinstance(outcome, BaseException):
        return getattr(outcome, "status", INTERNAL)
    return OK if getattr(outcome, "total", 0) else NOTHING
