"""Errors of the public functions."""

from __future__ import annotations

import difflib


class PanelError(Exception):
    pass


class UserInputError(PanelError, ValueError):
    """An argument that can't be used, with the nearest valid names where there are any."""

    def __init__(self, func: str, field: str, value: object, expected: str, candidates: list[str] | None = None):
        near = difflib.get_close_matches(str(value), candidates or [], 3)
        super().__init__(f"{func}: {field}={value!r}; expected {expected}" + (f". Did you mean {', '.join(near)}?" if near else ""))
        self.func, self.field, self.value, self.expected, self.suggestions = func, field, value, expected, near


class IncompatibleAxisError(PanelError, ValueError):
    """A metric that doesn't apply to a signal's cell."""


class IncompatibleInferenceError(PanelError, ValueError):
    """An inference method that a metric doesn't offer."""


class InsufficientSampleError(PanelError, ValueError):
    """A sample below a metric's floor under the strict policy."""
