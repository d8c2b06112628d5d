"""Calls of an outside service, text by text: each different text is answered once, and stays answered.

Answers are kept in a table by the hash of service and text, so that a run after a failure, or over more
texts, calls only for what has no answer yet.  Texts are called for in waves, each committed on its own:
what a lost executor costs is part of a wave.  Their cost doesn't grow with their number: texts are staged
once for all waves, and kept answers are merged once, with the last.  Within a task a bounded number of calls is open at a time.
A call that takes too long, or fails for a passing reason, is tried again after a growing wait; any other
failure is that text's error at once, and never the job's.

Null texts aren't called for and have neither answer nor error.  Equal texts share a call.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.operators import reconcile
from vitalspark.sources.versions import BUCKET, VersionedTable

ANSWER = "id string, answer string, error string, attempts int, answered_at timestamp"
#: Failures that pass: worth another try.
PASSING = (TimeoutError, ConnectionError)


class Policy(NamedTuple):
    """attempts for a text; seconds for one of them; the first wait, doubled each time; calls open at a time in a task; tasks; texts of a wave, at most."""

    attempts: int = 3
    timeout: float = 30.0
    backoff: float = 0.5
    concurrency: int = 5
    tasks: int = 8
    wave: int = 200_000


Job = tuple[str, str, int]  # id, text, number of its next try
Result = tuple[str, str | None, str | None, int]  # id, answer, error, attempts


class _Calls:
    """The calls of a task: each of some threads takes a text, tries until its result stands, and takes the next.

    A thread whose call takes too long is left to itself, as Python can't end it; another goes on in its place.
    """

    def __init__(self, call: Callable[[str], str], policy: Policy):
        self.call, self.policy = call, policy
        self.todo: deque[Job] = deque()
        self.done: deque[Result] = deque()
        self.open: dict[object, tuple[float, Job]] = {}  # calls that run: until when, for what; who takes one out decides on it
        self.idle, self.closed, self.changed = 0, False, threading.Condition()

    def results(self, batches: Iterable[Iterable[tuple[str, str]]]) -> Iterator[list[Result]]:
        """What is done so far, each time that more is to be had or all is read; texts of a batch and what was open before it are held at a time."""
        try:
            for _ in range(self.policy.concurrency):
                self._start(None)
            for batch in batches:
                with self.changed:
                    self.todo.extend((i, text, 1) for i, text in batch)
                    self.changed.notify_all()
                self._watch(lambda: not self.todo)
                yield self._taken()
            self._watch(lambda: not self.todo and self.idle == self.policy.concurrency)
            yield self._taken()
        finally:
            with self.changed:
                self.closed = True
                self.changed.notify_all()

    def _taken(self) -> list[Result]:
        return [self.done.popleft() for _ in range(len(self.done))]

    def _start(self, job: Job | None) -> None:
        threading.Thread(target=self._run, args=(job,), daemon=True).start()

    def _watch(self, over: Callable[[], bool]) -> None:
        """Wait until over(), and give up calls whose time is over."""
        while True:
            with self.changed:
                if over():
                    return
                now = time.monotonic()  # a call that begins later has its whole time from now at least
                self.changed.wait(max(0.0, min([now + self.policy.timeout, *(until for until, _ in self.open.copy().values())]) - now))
            now = time.monotonic()
            for key, (until, job) in self.open.copy().items():
                if until <= now and self.open.pop(key, None):
                    self._start(self._next(job, None, f"TimeoutError: no answer in {self.policy.timeout:g} s", True))

    def _next(self, job: Job, answer: str | None, error: str | None, passing: bool) -> Job | None:
        """The next try, or none where the result stands."""
        i, text, n = job
        if passing and n < self.policy.attempts:
            return i, text, n + 1
        self.done.append((i, answer, error, n))
        return None

    def _run(self, job: Job | None) -> None:
        while not self.closed and (job := job or self._take()):
            _, text, n = job
            if n > 1:
                time.sleep(self.policy.backoff * 2 ** (n - 2))
            self.open[key := object()] = time.monotonic() + self.policy.timeout, job
            try:
                got = self.call(text), None, False
            except Exception as e:  # this text's error, not the job's
                got = None, f"{type(e).__name__}: {e}", isinstance(e, PASSING)
            if not self.open.pop(key, None):
                return  # it took too long, and another thread has gone on
            job = self._next(job, *got)

    def _take(self) -> Job | None:
        """The next text, as soon as there is one; none at the end."""
        while True:
            try:
                return self.todo.popleft()
            except IndexError:
                with self.changed:
                    self.idle += 1
                    self.changed.notify_all()
                    self.changed.wait_for(lambda: self.todo or self.closed)
                    self.idle -= 1
                    if self.closed:
                        return None


def attempt(call: Callable[[str], str], text: str, policy: Policy) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts)."""
    [(_, *got)] = [r for done in _Calls(call, policy).results([[("", text)]]) for r in done]
    return tuple(got)


def _called(texts: DataFrame, call: Callable[[str], str], policy: Policy) -> DataFrame:
    """id, answer, error, attempts of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for b in batches)
        for done in _Calls(call, policy).results(pairs):
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["id", "answer", "error", "attempts"])

    return texts.mapInArrow(run, "id string, answer string, error string, attempts int")


def text_id(service: str, text: str = "text"):
    """Hash of service and text: the key of an answer.  The service's name should change with whatever changes its answers: model, prompt, version."""
    return F.sha2(F.concat(F.lit(f"{service}\n"), F.col(text)), 256)


def answers_table(spark, folder: str, buckets: int = 16) -> VersionedTable:
    return VersionedTable(spark, folder, ANSWER, ("id",), buckets)


def _waves(texts: DataFrame, folder: str, most: int) -> list[DataFrame]:
    """texts by waves of `most` at most.  They are made once and written to the folder; a wave is some of its files, so that each is read once."""
    spark = texts.sparkSession
    texts.write.option("maxRecordsPerFile", -(-most // 8)).parquet(folder)  # so that a wave is nearly full
    load = spark.read.schema(texts.schema).parquet
    waves: list[list[str]] = []
    size = most
    for name, n in sorted(load(folder).groupBy("_metadata.file_name").count().collect()):
        if size + n > most:
            waves.append([])
            size = 0
        waves[-1].append(f"{folder}/{name}")
        size += n
    return [load(*files) for files in waves]


def _answers(kept: VersionedTable) -> DataFrame:
    """The last row of each id.  Waves append theirs, until the last one of a run merges them: there is one row then, and Spark can split a join with it where many rows share a text."""
    last = kept.log.read()
    rows = kept.read(last.number)
    return reconcile.latest(rows, ("id",), "answered_at", "answer") if last.appended else rows


def ask(rows: DataFrame, service: str, call: Callable[[str], str], kept: VersionedTable, policy: Policy = Policy()) -> DataFrame:
    """rows (with text) and answer, error, attempts of each.  Texts with an answer in `kept` aren't called for; those with an error are, again."""
    texts = rows.where("text IS NOT NULL").select(text_id(service).alias("id"), "text").groupBy("id").agg(F.first("text").alias("text"))
    staged = kept.log.new_folder()
    try:
        waves = _waves(texts.join(_answers(kept).where("error IS NULL").select("id"), "id", "left_anti"), staged, policy.wave)
        for k, wave in enumerate(waves, 1):
            found = _called(wave.repartition(policy.tasks, "id"), call, policy).withColumn("answered_at", F.current_timestamp())
            if k < len(waves):
                kept.append(found)
            else:
                kept.upsert(found, lambda x: reconcile.newest(x, (BUCKET, "id"), "answered_at"), fold=True)
    finally:
        kept.log.delete(staged)
    got = _answers(kept).select(F.col("id").alias("_id"), "answer", "error", "attempts")
    return rows.withColumn("_id", text_id(service)).join(got, "_id", "left").drop("_id")


class FlakyLength:
    """A service for trials, without a network: the text's length, at the second try for lengths that 3 divides, and never for those that end in 7; texts that start with white space are refused."""

    def __init__(self):
        self.tried: set[str] = set()

    def __call__(self, text: str) -> str:
        if len(text) % 10 == 7:
            raise ConnectionError("down")
        if text.startswith((" ", "\t", "\n", "\f", "\r")):
            raise ValueError("starts with white space")
        if len(text) % 3 == 0 and text not in self.tried:
            self.tried.add(text)
            raise TimeoutError("busy")
        return str(len(text))
