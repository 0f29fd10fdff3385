"""Answers of a language model that the caller brings; without one, or while it is paused, there are none."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds without calls after a call that took too long, after any other failure, and at least.
SLOW_PAUSE, ERROR_PAUSE, LEAST_PAUSE = 180, 120, 15


class Breaker:
    """Calls a model unless a failure lies too short a time back; a failed call gives None."""

    def __init__(self, call: Callable[[str], str] | None, slow_pause: float = SLOW_PAUSE, error_pause: float = ERROR_PAUSE, clock: Callable[[], float] = time.monotonic):
        self.call, self.slow_pause, self.error_pause, self.clock = call, slow_pause, error_pause, clock
        self.closed_until = float("-inf")

    def __call__(self, prompt: str | None) -> str | None:
        if self.call is None or prompt is None or self.clock() < self.closed_until:
            return None
        try:
            return str(self.call(prompt)).strip()
        except Exception as e:
            pause = self.slow_pause if isinstance(e, TimeoutError) else self.error_pause
            self.closed_until = self.clock() + max(LEAST_PAUSE, pause)
            return None


def replies(prompt: Column | str, load: Callable[[], Callable[[str], str]] | None = None) -> Column:
    """The answer to each prompt, null where there is none. load() makes the model once in each task; each task has a breaker."""
    if load is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def answered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = Breaker(load())
        for prompts in batches:
            yield prompts.map(ask, na_action="ignore").astype(object)

    return answered(prompt)
