"""Work that runs while the driver goes on: events that stand for Spark jobs, barriers over them, waits with a limit."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, TimeoutError, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..operators.arrayframe import ArrayFrame
from ..plans.domain import tile_domain


class Event:
    """Something that ends. It carries an error to whoever waits; an event made of others fails when one of them does."""

    def __init__(self, futures: Iterable[Future] = ()) -> None:
        self._futures = list(futures)

    @property
    def is_done(self) -> bool:
        return all(f.done() for f in self._futures)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether it ended within the limit; raises what the work raised."""
        done, open_ = wait(self._futures, seconds)
        for f in done:
            f.result()
        return not open_

    def result(self, seconds: float | None = None) -> object:
        """What the (last) piece of work returned; TimeoutError beyond the limit."""
        if not self.wait(seconds):
            raise TimeoutError
        return self._futures[-1].result() if self._futures else None

    def on_done(self, call: Callable[[], None]) -> None:
        """Calls once when everything ended, also after an error."""
        left, lock = [len(self._futures)], threading.Lock()
        if not self._futures:
            call()
            return

        def one(_: Future) -> None:
            with lock:
                left[0] -= 1
                last = left[0] == 0
            if last:
                call()

        for f in self._futures:
            f.add_done_callback(one)


def join(*events: Event) -> Event:
    """An event after all; of none, one that is done."""
    return events[0] if len(events) == 1 else Event(f for e in events for f in e._futures)


class Runner:
    """Submits Spark actions from threads of one session; `pool` names the scheduler pool that they share, `owners` who may own chunks
    of its domains (by default as many as there are cores).

    With debug, work runs at once in the caller's thread, one piece after the other; its error still comes with the event.
    """

    def __init__(self, spark: SparkSession, threads: int = 8, pool: str | None = None, debug: bool = False, owners: Iterable[int] | None = None) -> None:
        self.spark, self.pool, self.debug = spark, pool, debug
        self.owners = tuple(owners if owners is not None else range(spark.sparkContext.defaultParallelism))
        self._threads = ThreadPoolExecutor(threads)
        self._open: list[Event] = []
        self._kept: list[DataFrame] = []
        self._writers: dict[int, Event] = {}
        self._lock = threading.Lock()

    def constrain_to(self, *owners: int, pool: str | None = None) -> Runner:
        """A runner for some of the owners, whose work may go to a scheduler pool. ValueError for none at all, or for an owner that this one hasn't."""
        if not owners and not pool:
            raise ValueError("neither owners nor a pool")
        if unknown := set(owners) - set(self.owners):
            raise ValueError(f"no owners {sorted(unknown)}")
        return Runner(self.spark, self._threads._max_workers, pool or self.pool, self.debug, owners or self.owners)

    def tile_domain(self, size: Sequence[int], tile: Sequence[int]) -> DataFrame:
        """The chunks of a domain, owned by this runner's owners in turn."""
        return tile_domain(self.spark, size, tile, self.owners)

    def submit(self, work: Callable[[], object], after: Iterable[Event] = (), reads: Iterable[ArrayFrame] = (), writes: Iterable[ArrayFrame] = ()) -> Event:
        """Runs work when the events are done; their errors become its own. So do those of the work that wrote the arrays named in
        `reads` or `writes`: an array whose writer failed is poisoned until other work writes it."""
        writes = list(writes)
        with self._lock:
            after = [*after, *(self._writers[id(a.root)] for a in reads if id(a.root) in self._writers)]

        def run() -> object:
            for e in after:
                e.wait()
            if self.pool:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", self.pool)
            return work()

        future: Future = Future()

        def settle() -> None:
            try:
                future.set_result(run())
            except BaseException as e:  # noqa: BLE001
                future.set_exception(e)

        event = Event([future])
        with self._lock:
            self._writers |= {id(a.root): event for a in writes}
            self._open = [e for e in self._open if not e.is_done] + [event]
        if self.debug:
            settle()
        else:
            # wrapped here, so that it takes over the local properties of the thread that submits
            self._threads.submit(inheritable_thread_target(self.spark)(settle))
        return event

    def compute(self, target: ArrayFrame | DataFrame, after: Iterable[Event] = ()) -> Event:
        """Computes and keeps the cells of an array or table, until trim_memory."""
        df = target.df if isinstance(target, ArrayFrame) else target

        def work() -> int:
            with self._lock:
                self._kept.append(df)
            return df.persist().count()

        return self.submit(work, after, writes=[target] if isinstance(target, ArrayFrame) else [])

    def barrier(self) -> Event:
        """An event after everything submitted so far."""
        with self._lock:
            return join(*self._open)

    def synchronize(self, *arrays: ArrayFrame) -> None:
        """Waits for everything, or for the work that writes these arrays; raises what it raised."""
        if not arrays:
            self.barrier().wait()
        for a in arrays:
            with self._lock:
                event = self._writers.get(id(a.root), Event())
            event.wait()

    def info(self) -> dict[str, object]:
        sc = self.spark.sparkContext
        return {"parallelism": sc.defaultParallelism, "master": sc.master, "version": self.spark.version}

    def trim_memory(self) -> None:
        """Frees what compute() kept; other cached tables of the session stay."""
        with self._lock:
            kept, self._kept = self._kept, []
        for df in kept:
            df.unpersist()

    def shutdown(self) -> None:
        self._threads.shutdown(wait=True)
