"""Deadlines and cancellation of running flows: Spark jobs in a group of their own."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

#: Fixed value: seconds that a flow may take unless the caller says otherwise.
FLOW_SECONDS = 300.0


@dataclass
class Outcome:
    """complete, timeout or cancelled (with what the action returned), and the seconds it took."""

    status: str
    value: Any
    elapsed_seconds: float
    timeout_seconds: float | None = None


class Control:
    """Runs actions so that they can be cancelled from another thread."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self._why = spark, f"flow-{uuid.uuid4().hex}", None

    def cancel(self, why: str = "cancelled") -> None:
        self._why = self._why or why
        self.spark.sparkContext.cancelJobGroup(self.tag)

    def run(self, action: Callable[[], Any], timeout: float | None = FLOW_SECONDS) -> Outcome:
        """The action's outcome; errors that neither the deadline nor cancel() caused are raised."""
        began = time.monotonic()
        timer = threading.Timer(timeout, self.cancel, ("timeout",)) if timeout else None
        self.spark.sparkContext.setJobGroup(self.tag, "flow", interruptOnCancel=True)
        try:
            if timer:
                timer.daemon = True
                timer.start()
            value = action()
            return Outcome(self._why or "complete", None if self._why else value, time.monotonic() - began, timeout)
        except Exception:
            if self._why is None:
                raise
            return Outcome(self._why, None, time.monotonic() - began, timeout)
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            if timer:
                timer.cancel()
