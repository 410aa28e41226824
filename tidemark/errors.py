"""Exceptions; each prints as ``[Tag: message]``."""

from __future__ import annotations


class TidemarkError(Exception):
    tag = "Error"

    def __str__(self) -> str:
        return f"[{self.tag}: {super().__str__()}]"


class NotFoundError(TidemarkError):
    tag = "NotFound"


class CorruptionError(TidemarkError):
    tag = "Corruption"


class StorageError(TidemarkError):
    tag = "IOError"


class InvalidArgumentError(TidemarkError):
    tag = "InvalidArgument"


class ConflictError(TidemarkError):
    """Another writer published the same version first."""

    tag = "Conflict"
