"""Errors of the engine; all are ValueErrors."""

from __future__ import annotations


class ChunkloomError(ValueError):
    """Anything that the engine rejects."""


class UnsupportedType(ChunkloomError):
    """A column type, or an encoding for a type, that is not supported."""


class CorruptData(ChunkloomError):
    """Encoded bytes that can't be what an encoder wrote."""


class InvalidOption(ChunkloomError):
    """An option, hint or column name that makes no sense."""
