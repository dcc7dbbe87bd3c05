"""Refusals: what the engine declines to do, each with a code and an alternative."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Refusal:
    code: str
    path: str
    message: str
    alternative: str = ""


class Refused(ValueError):
    """Raised with one or more refusals; nothing was executed."""

    def __init__(self, *refusals: Refusal):
        self.refusals = refusals
        super().__init__("; ".join(f"{r.code} at {r.path}: {r.message}" for r in refusals))

    @property
    def code(self) -> str:
        return self.refusals[0].code


def refuse(code: str, path: str, message: str, alternative: str = "") -> None:
    raise Refused(Refusal(code, path, message, alternative))
