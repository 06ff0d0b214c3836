"""Sources that fail for a while: what may pass, how long to wait, and where to go on.

A remote source is read by a function of a cursor (rows read so far). Errors that may pass, also as the cause of
another error, lead to a new call from the cursor after a growing delay; others end the reading, as do too many."""

from __future__ import annotations

import http.client
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

#: Errors of the network that may pass, by type, and by name where their packages may be absent.
PASSING = (ConnectionError, TimeoutError, http.client.IncompleteRead, http.client.RemoteDisconnected)
PASSING_NAMES = {"ChunkedEncodingError", "ConnectTimeout", "ReadTimeout", "ReadTimeoutError", "NewConnectionError", "ProtocolError", "IncompleteRead"}


@dataclass(frozen=True)
class Limits:
    """Failures in a row, and in all, after which the reading ends; seconds of the first and of the longest delay."""

    in_a_row: int = 12
    in_all: int = 100
    first: float = 2.0
    longest: float = 60.0

    def delay(self, failures: int) -> float:
        return min(self.longest, self.first * 2 ** max(0, failures - 1))


class GaveUp(RuntimeError):
    """More failures than the limits allow."""


def causes(error: BaseException | None) -> Iterator[BaseException]:
    """The error and what led to it, each once."""
    seen = []
    while error is not None and not any(error is x for x in seen):
        seen.append(error)
        yield error
        error = error.__cause__ if error.__cause__ is not None else error.__context__


def may_pass(error: BaseException) -> bool:
    return any(isinstance(x, PASSING) or PASSING_NAMES & {t.__name__ for t in type(x).__mro__} for x in causes(error))


def steady(rows_from: Callable[[int], Iterable], start: int = 0, limits: Limits | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """The rows from `start` on, over all failures that may pass: each row once."""
    limits, cursor, row, total = limits or Limits(), start, 0, 0
    while True:
        try:
            for item in rows_from(cursor):
                yield item
                cursor, row = cursor + 1, 0
            return
        except Exception as error:
            if not may_pass(error):
                raise
            row, total = row + 1, total + 1
            if row > limits.in_a_row or total > limits.in_all:
                raise GaveUp(f"{total} failures, {row} in a row, after {cursor - start} rows") from error
            sleep(limits.delay(row))
