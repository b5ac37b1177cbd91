"""Errors with a code, and the exit code of each kind."""

from __future__ import annotations

import errno


class DriftError(Exception):
    """An error whose message holds no cell value, key or hash."""

    exit_code = 4

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class UsageError(DriftError):
    exit_code = 2

    def __init__(self, message: str):
        super().__init__("USAGE", message)


class SpecError(DriftError):
    exit_code = 2

    def __init__(self, message: str):
        super().__init__("SPEC_INVALID", message)


class InputError(DriftError):
    pass


class LimitError(DriftError):
    exit_code = 5


def failure(error: BaseException) -> tuple[int, dict]:
    """Exit code and the value-free description of an error."""
    if isinstance(error, OSError) and error.errno in (errno.ENOSPC, errno.EDQUOT):
        return 5, {"status": "FAILED", "code": "DISK_FULL", "message": "output storage is full"}
    if isinstance(error, DriftError):
        return error.exit_code, {"status": "FAILED", "code": error.code, "message": str(error)}
    found = tagged(error)
    if found:
        return found.exit_code, {"status": "FAILED", "code": found.code, "message": str(found)}
    return 6, {"status": "FAILED", "code": "INTERNAL_ERROR", "message": "unexpected error"}


def tagged(error: BaseException) -> DriftError | None:
    """The error a task raised under a fixed message, found in Spark's error text."""
    import re

    m = re.search(r"driftframe:([A-Z_]+):([^\n]*?):driftframe", str(error))
    if not m:
        return None
    kind = LimitError if m[1].endswith("_LIMIT_EXCEEDED") else InputError
    return kind(m[1], m[2])


def tag(code: str, message: str) -> str:
    return f"driftframe:{code}:{message}:driftframe"
