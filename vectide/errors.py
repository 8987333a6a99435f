"""Refusals with stable names. A result is whole or it is refused; there are no partial answers."""

from __future__ import annotations

#: The names that callers may rely on.
NAMED = (
    "mixed_calibration",
    "dimension_mismatch",
    "bit_width_mismatch",
    "node_unreachable",
    "empty_collection",
    "ambiguous_index",
    "positional_index_required",
    "index_not_empty",
    "labelled_index_immutable",
    "row_count_mismatch",
    "invalid_calibration",
)


class CollectionError(Exception):
    """``name: detail``. is_named tells the names of NAMED from other failures."""

    def __init__(self, name: str, detail: str = ""):
        super().__init__(f"{name}: {detail}" if detail else name)
        self.name, self.detail = name, detail

    @classmethod
    def parse(cls, message: str) -> CollectionError:
        name, _, detail = message.partition(": ")
        return cls(name, detail)

    @property
    def is_named(self) -> bool:
        return self.name in NAMED


class InvalidArgument(ValueError):
    """A malformed request."""


class FailedPrecondition(RuntimeError):
    """A request that the index's state doesn't allow."""


class Aborted(RuntimeError):
    """An operation that another one has overtaken."""


class ResourceExhausted(RuntimeError):
    """A request above a limit."""


class NotFound(KeyError):
    """An unknown index."""
