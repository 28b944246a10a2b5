"""Runs of named steps, each timed; a run happens once, and any step can be replaced before it."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[dict], object]


class Run:
    """Steps in order, each a function of the state that they share; what a step returns, a number or text, is its result."""

    def __init__(self, steps: Sequence[tuple[str, Step]], overrides: Mapping[str, Step] | None = None):
        unknown = set(overrides or {}) - {n for n, _ in steps}
        if unknown:
            raise ValueError(f"no such steps: {sorted(unknown)}")
        self.steps = [(n, (overrides or {}).get(n, s)) for n, s in steps]
        self.state: dict = {}
        self.started = False

    def __call__(self, spark: SparkSession) -> DataFrame:
        """(step, seconds, result); raises if this run was started before, and when a step raises."""
        if self.started:
            raise RuntimeError("this run was started before")
        self.started, rows = True, []
        for name, step in self.steps:
            began = time.time()
            got = step(self.state)
            rows.append((name, time.time() - began, str(got)))
        return spark.createDataFrame(rows, "step string, seconds double, result string")
