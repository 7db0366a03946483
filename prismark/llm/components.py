"""Connected components of near copies: those of the tracks."""

from ..operators.graphs import connected as components

__all__ = ["components"]
