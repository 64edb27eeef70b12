"""Writes that need a confirmation: one-shot proposals with a code, which expire."""

from __future__ import annotations

import hmac
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

TTL = 600


class GateError(RuntimeError):
    pass


@dataclass(frozen=True)
class Ticket:
    proposal: str
    code: str
    expires: float


class Gate:
    """Holds payloads until they are confirmed; it writes nothing itself."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self._clock, self._open = clock, {}

    def propose(self, payload: Any, ttl: float = TTL) -> Ticket:
        self.sweep()
        t = Ticket(secrets.token_hex(8), f"{secrets.randbelow(10**6):06d}", self._clock() + ttl)
        self._open[t.proposal] = (t, payload)
        return t

    def confirm(self, proposal: str, code: str) -> Any:
        """The payload, once. A wrong code leaves the proposal open."""
        if proposal not in self._open:
            raise GateError("no such proposal, or it was used")
        t, payload = self._open[proposal]
        if self._clock() > t.expires:
            del self._open[proposal]
            raise GateError("the proposal has expired")
        if not hmac.compare_digest(code.encode(), t.code.encode()):
            raise GateError("wrong code")
        del self._open[proposal]
        return payload

    def sweep(self) -> int:
        gone = [p for p, (t, _) in self._open.items() if self._clock() > t.expires]
        for p in gone:
            del self._open[p]
        return len(gone)

    def pending(self) -> int:
        return len(self._open)
