"""Runs a graph of stages: bounded concurrency, deadlines that cancel work on the cluster, isolated failures.

A stage is a function from the tables it needs to one table, which is written to the shared folder
under the stage's own job tag. Stages whose needs are there run side by side, at most so many at once.
A stage over its time has its jobs cancelled by tag and counts as failed; its siblings go on. What
a failed stage feeds is skipped, unless it can do without that input or has a table to fall back on.
The log of a run is a table with a row for each stage.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.runtime import Scratch

LOG = "run string, stage string, ok boolean, status string, duration_ms double, n_rows bigint, error string"
COMPLETED, FAILED, TIMED_OUT, SKIPPED, DEGRADED = "completed", "failed", "timed out", "skipped", "degraded"
_POLL = 0.2
_GRACE = 30.0  # seconds that a cancelled stage has to end; after them nobody waits for its thread


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[..., DataFrame]  # called with its inputs by name
    needs: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()  # inputs that are None where their stage failed
    fallback: Callable[[str], DataFrame] | None = None  # from the error to the table that stands in
    timeout: float | None = None  # seconds


@dataclass
class Run:
    name: str
    outputs: dict[str, DataFrame]
    log: DataFrame
    status: dict[str, str] = field(default_factory=dict)

    @property
    def partial(self) -> bool:
        """Some stages went well and some did not."""
        good = [s == COMPLETED for s in self.status.values()]
        return any(good) and not all(good)


def _checked(stages: list[Stage], inputs: dict[str, DataFrame]) -> None:
    known = set(inputs)
    if len({s.name for s in stages} | known) != len(stages) + len(known):
        raise ValueError("stages and inputs need names of their own")
    left = list(stages)
    while left:
        ready = [s for s in left if known.issuperset(s.needs + s.optional)]
        if not ready:
            raise ValueError(f"stages wait for each other or for no stage: {[s.name for s in left]}")
        known.update(s.name for s in ready)
        left = [s for s in left if s not in ready]


def run_stages(
    spark: SparkSession, stages: list[Stage], inputs: dict[str, DataFrame] | None = None, *, most: int = K.SECTION_CONCURRENCY, timeout: float | None = None, name: str | None = None
) -> Run:
    """All stages, at most so many at once; timeout is for the whole run, after which no stage goes on or begins."""
    inputs, name = inputs or {}, name or uuid.uuid4().hex[:12]
    _checked(stages, inputs)
    sc, scratch = spark.sparkContext, Scratch(spark, f"run-{name}")
    outputs, status, rows, started = dict(inputs), {}, {}, {}
    end = time.monotonic() + timeout if timeout else None

    def work(s: Stage) -> tuple[DataFrame, int]:
        started[s.name] = time.monotonic()
        sc.addJobTag(f"{name}-{s.name}")
        try:
            seen = Observation()
            df = s.run(**{n: outputs.get(n) for n in s.needs + s.optional})
            return scratch.keep(df.observe(seen, F.count(F.lit(1)).alias("n")), s.name), seen.get["n"]
        finally:
            sc.removeJobTag(f"{name}-{s.name}")

    def finish(s: Stage, state: str, n: int | None = None, error: str | None = None) -> None:
        spent = (time.monotonic() - started[s.name]) * 1000 if s.name in started else 0.0
        status[s.name] = state
        if state != COMPLETED and s.fallback is not None:
            status[s.name] = DEGRADED
            outputs[s.name] = s.fallback(error or state)
        rows[s.name] = (name, s.name, state == COMPLETED, status[s.name], spent, n, error and error[:500])

    pool = ThreadPoolExecutor(max(1, most))
    running: dict[Future, Stage] = {}
    late: dict[str, float] = {}
    waiting = list(stages)
    try:
        while waiting or running:
            for s in list(waiting):
                if end and time.monotonic() > end:
                    waiting.remove(s)
                    finish(s, SKIPPED, error="the run's time is over")
                elif all(n in outputs or n in status for n in s.needs + s.optional):
                    waiting.remove(s)
                    if missing := [n for n in s.needs if n not in outputs]:
                        finish(s, SKIPPED, error=f"needs {', '.join(missing)}")
                    elif len(running) < most:
                        running[pool.submit(inheritable_thread_target(work), s)] = s
                    else:
                        waiting.insert(0, s)
                        break
            done, _ = wait(running, timeout=_POLL, return_when=FIRST_COMPLETED) if running else (set(), None)
            for f in done:
                s = running.pop(f)
                if error := f.exception():
                    finish(s, TIMED_OUT if s.name in late else FAILED, error="timed out" if s.name in late else str(error) or type(error).__name__)
                else:
                    outputs[s.name], n = f.result()
                    finish(s, COMPLETED, n)
            now = time.monotonic()
            for f, s in list(running.items()):
                limits = [x for x in (s.timeout and s.name in started and started[s.name] + s.timeout, end) if x]
                if limits and now > min(limits):
                    late.setdefault(s.name, now)
                    # Again and again, as a stage may have begun another job since.
                    sc.cancelJobsWithTag(f"{name}-{s.name}")
                    if now > late[s.name] + _GRACE:
                        running.pop(f)
                        finish(s, TIMED_OUT, error="timed out")
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    log = spark.createDataFrame([rows[s.name] for s in stages], LOG)
    return Run(name, {s.name: outputs[s.name] for s in stages if s.name in outputs}, log, {s.name: status[s.name] for s in stages})
