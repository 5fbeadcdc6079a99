"""What can go wrong, by who can mend it."""

from __future__ import annotations


class TidewellError(RuntimeError):
    """Base class. context() adds where it happened, once for each place."""

    def context(self, where: str) -> "TidewellError":
        text = str(self)
        if not text.startswith(f"{where}: "):
            self.args = (f"{where}: {text}",)
        return self


class ConfigError(TidewellError):
    """The call asks for something that cannot be done as asked."""


class UnsupportedType(TidewellError):
    """A column has a type that no table can take."""


class SourceError(TidewellError):
    """A source failed. transient: the same call may work again."""

    def __init__(self, text: str, transient: bool = False):
        super().__init__(text)
        self.transient = transient


class ValidationFailed(TidewellError):
    """A quality gate refused the staged rows; result holds what it found."""

    def __init__(self, result: object):
        super().__init__(f"the staged rows did not pass: {result}")
        self.result = result


class CommitConflict(TidewellError):
    """Another writer committed first."""


#: SQL states and vendor codes after which the same read may work again.
TRANSIENT_STATES = ("40001", "57014", "08000", "08001", "08003", "08004", "08006")
TRANSIENT_CODES = (1205, 1213)
TRANSIENT_WORDS = ("connection reset", "connection closed", "connection refused", "broken pipe", "communications link failure")


def transient(error: BaseException) -> bool:
    """Whether a whole transfer may be tried again after this error."""
    if isinstance(error, SourceError):
        return error.transient
    text = str(error).lower()
    return any(f"sqlstate {s}" in text or f"sqlstate: {s}" in text for s in TRANSIENT_STATES) or any(f"error code: {c}" in text or f"error {c}" in text for c in TRANSIENT_CODES) or any(w in text for w in TRANSIENT_WORDS)
