"""Limits and errors of the versioned key-value model."""

from __future__ import annotations

MAX_LEVELS = 7


class StoreError(Exception):
    """Base of the store's errors; `kind` is its class for callers that retry."""

    kind = "fatal"


class KeyNotFound(StoreError):
    kind = "not_found"


class InvalidConfig(StoreError):
    pass


class KeyTooLarge(StoreError):
    pass


class CommitConflict(StoreError):
    kind = "busy"


class Corruption(StoreError):
    kind = "corruption"


class StoreClosed(StoreError):
    kind = "retryable"


class UnknownProperty(StoreError):
    pass


class WriteStall(StoreError):
    kind = "busy"
