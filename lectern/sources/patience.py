"""Requests to a service that may be busy, slow or closed: waits, tries, and a budget of seconds."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

# Seconds between tries, and requests left below which a reader slows down.
LONGEST_WAIT, SHORTEST_WAIT, BUSY_WAIT, FAILED_WAIT = 60.0, 0.2, 5.0, 1.0
FEW_LEFT, FEW_WAIT, FEWER_LEFT, FEWER_WAIT = 100.0, 1.5, 30.0, 4.0
TRIES, BODY_TRIES = 5, 3


@dataclass(frozen=True)
class Answer:
    status: int = 200
    body: bytes = b""
    headers: Mapping[str, str] = field(default_factory=dict)

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)

    def number(self, name: str) -> float | None:
        try:
            return float(self.header(name) or "")
        except ValueError:
            return None


class Refused(Exception):
    """A request that more tries will not mend; ``kind`` is signed_out, forbidden, missing,
    failed (also: no connection, or a body that stays cut off) or out_of_time."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(kind, detail)
        self.kind, self.detail = kind, detail


def is_busy(answer: Answer) -> bool:
    return answer.status == 429 or answer.status == 403 and b"rate limit" in answer.body.lower()


def refusal(answer: Answer) -> str:
    """The kind of an answer of 400 or more.  Only a token that is turned down means signed_out;
    a 401 may also stand for a thing that this reader must not see."""
    if answer.status == 401:
        return "signed_out" if answer.header("WWW-Authenticate") or b"invalid access token" in answer.body.lower() else "forbidden"
    return {403: "forbidden", 404: "missing"}.get(answer.status, "failed")


class Patience:
    """Asks until there is an answer, for ``seconds`` over all requests.

    A wait is as long as the service says in ``Retry-After``, else it doubles from try to
    try.  Where few requests are left for the hour, answers are followed by a pause.  A wait
    that would go past the budget is not begun: the request is out_of_time.
    """

    def __init__(
        self, seconds: float = 600.0, tries: int = TRIES,
        sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, chance: Callable[[], float] = random.random,
    ) -> None:
        self.tries, self.sleep, self.clock, self.chance = tries, sleep, clock, chance
        self.until = clock() + seconds

    def _wait(self, seconds: float) -> None:
        if self.clock() + seconds > self.until:
            raise Refused("out_of_time", f"{seconds:.1f} s more")
        self.sleep(seconds)

    def _again(self, tried: int, least: float, told: float | None = None) -> None:
        grown = min(LONGEST_WAIT, least * 2 ** (tried - 1)) + self.chance() / 2
        self._wait(max(SHORTEST_WAIT, grown if told is None else told))

    def request(self, send: Callable[[], Answer]) -> Answer:
        """An answer below 400; others, and lost connections, are tried ``tries`` times if that can help."""
        tried = 0
        while True:
            tried += 1
            try:
                answer = send()
            except OSError as e:
                if tried >= self.tries:
                    raise Refused("failed", type(e).__name__) from e
                self._again(tried, FAILED_WAIT)
                continue
            if answer.status < 400:
                left = answer.number("X-Rate-Limit-Remaining")
                if left is not None and left < FEW_LEFT:
                    self._wait(FEW_WAIT if left > FEWER_LEFT else FEWER_WAIT)
                return answer
            busy = is_busy(answer)
            if not (busy or answer.status >= 500) or tried >= self.tries:
                raise Refused(refusal(answer), answer.body[:500].decode("utf-8", "replace"))
            self._again(tried, BUSY_WAIT if busy else FAILED_WAIT, answer.number("Retry-After"))

    def json(self, send: Callable[[], Answer]) -> object:
        """A decoded body, null for an empty one; a body that is cut off is asked for ``BODY_TRIES`` times."""
        for tried in range(1, BODY_TRIES + 1):
            body = self.request(send).body
            try:
                return json.loads(body) if body else None
            except ValueError:
                if tried < BODY_TRIES:
                    self._again(tried, FAILED_WAIT)
        raise Refused("failed", "body cut off")
