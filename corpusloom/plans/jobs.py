"""Long-running work beside the caller: phases, cancelling, results; each job is a Spark job group."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

FINAL = ("success", "failed", "timeout", "cancelled")


class Cancelled(Exception):
    pass


class Job:
    """Runs f(job) once. The first final state stands; cancelling also stops the group's Spark jobs."""

    def __init__(self, spark: SparkSession, f: Callable[["Job"], Any], timeout: float | None = None, tell: Callable[[str, Any], None] | None = None):
        self.id, self.spark, self.f, self.timeout, self.tell = uuid.uuid4().hex, spark, f, timeout, tell
        self.state, self.progress, self.result, self.error = "queued", 0.0, None, None
        self._lock, self._done, self._stop, self._started = threading.Lock(), threading.Event(), threading.Event(), False
        self.began: float | None = None

    def _end(self, state: str, result=None, error: str | None = None) -> bool:
        with self._lock:
            if self.state in FINAL:
                return False
            self.state, self.result, self.error = state, result, error
        self._done.set()
        if self.tell:
            self.tell("result" if state == "success" else "error", result if state == "success" else error)
            self.tell("done", state)
        return True

    def phase(self, share: float) -> None:
        """Told at the end of each phase; here a cancelled or late job stops, before it writes anything further."""
        if self._stop.is_set():
            raise Cancelled
        if self.timeout is not None and time.monotonic() - self.began > self.timeout:
            raise TimeoutError
        self.progress = share
        if self.tell:
            self.tell("progress", share)

    def _run(self) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup(self.id, "corpusloom job", interruptOnCancel=True)
        try:
            self.phase(0.0)
            result = self.f(self)
            self.phase(1.0)
            self._end("success", result)
        except Cancelled:
            self._end("cancelled")
        except TimeoutError:
            self._end("timeout", error="too late")
        except Exception as e:  # noqa: BLE001
            self._end("cancelled" if self._stop.is_set() else "failed", error=f"{type(e).__name__}: {e}")

    def start(self) -> "Job":
        with self._lock:
            if self._started:
                raise RuntimeError("a job runs once")
            self._started = True
            self.state = "running"
        self.began = time.monotonic()
        InheritableThread(target=self._run, daemon=True).start()
        return self

    def cancel(self) -> bool:
        if self.state in FINAL:
            return False
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self.id)
        if not self._started:
            self._end("cancelled")
        return True

    def wait(self, seconds: float | None = None) -> str:
        self._done.wait(seconds)
        return self.state


class Jobs:
    """Submits, finds and forgets jobs; of finished ones only the last `most` are kept."""

    def __init__(self, spark: SparkSession, most: int = 200):
        self.spark, self.most, self._jobs = spark, most, {}

    def submit(self, f: Callable[[Job], Any], **options) -> Job:
        job = Job(self.spark, f, **options)
        self._jobs[job.id] = job
        done = [j for j in self._jobs.values() if j.state in FINAL]
        for j in done[: max(0, len(done) - self.most)]:
            del self._jobs[j.id]
        return job.start()

    def get(self, job_id: str) -> Job | None:
        return self._jobs.get(job_id)

    def gather(self) -> dict[str, str]:
        return {i: j.wait() for i, j in list(self._jobs.items())}

    def forget(self, job_id: str) -> bool:
        job = self._jobs.get(job_id)
        if job is None or job.state not in FINAL:
            return False
        return self._jobs.pop(job_id) is not None
