"""Named wall-clock measurements around Spark actions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Timer:
    """Seconds by name, in the order in which the operations ended."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        started = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - started
