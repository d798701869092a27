"""Errors that say what was being done and what may help."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class PipelineError(Exception):
    """Base of the package's errors; ``context`` grows outwards as the error passes through the layers."""

    def __init__(self, message: str, *, hints: Iterable[str] = ()):
        super().__init__(message)
        self.message, self.context, self.hints = message, [], list(hints)

    def within(self, what: str) -> PipelineError:
        self.context.append(what)
        return self

    def suggestions(self) -> list[str]:
        return list(self.hints)

    def __str__(self) -> str:
        where = "".join(f"{c}: " for c in reversed(self.context))
        return where + self.message + "".join(f"\n  hint: {h}" for h in self.hints)


class SchemaError(PipelineError):
    """A column or type that isn't there."""


class ExpressionError(PipelineError):
    """An expression that can't be read or typed."""


class ConfigError(PipelineError):
    """A setting or step that isn't known."""


class SourceError(PipelineError):
    """A source or destination that can't be used."""


def missing_column(name: str, have: Iterable[str]) -> SchemaError:
    have = list(have)
    close = difflib.get_close_matches(name, have, 1)
    hints = ([f"did you mean '{close[0]}'?"] if close else []) + [f"available columns: {', '.join(have) or 'none'}"]
    return SchemaError(f"column '{name}' not found", hints=hints)


def unknown(kind: str, name: object, known: Iterable[str]) -> ConfigError:
    known = list(known)
    close = difflib.get_close_matches(str(name), known, 1)
    hints = ([f"did you mean '{close[0]}'?"] if close else []) + [f"known: {', '.join(known)}"]
    return ConfigError(f"unknown {kind} '{name}'", hints=hints)
