"""Connected components: those of the engine."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
