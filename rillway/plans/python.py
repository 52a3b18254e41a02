"""Python operators in their tasks: attempts, limits, deadlines, the run's store, handles that aren't taken."""

from __future__ import annotations

import json
import multiprocessing
import pickle
import time
from collections.abc import Callable, Generator, Iterable, Iterator
from multiprocessing.connection import wait
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

#: The fault of a run whose deadline has passed.
LATE = "TimeoutError: the run's time is over"
#: Runs of a task that may wait side by side, and after how many seconds a task looks again whether they do.
SIDE_BY_SIDE, LOOK = 8, 0.01


class Attempts:
    """Calls of a Python operator that may take too long: they run in a process of their own, which is ended at the limit,
    so that no attempt goes on beside the next. The process is kept from call to call while it is in time."""

    def __init__(self, fn: Callable):
        self.fn, self.process, self.pipe = fn, None, None

    def _begin(self, others: list[Attempts]) -> None:
        fork = multiprocessing.get_context("fork")
        self.pipe, theirs = fork.Pipe()
        self.process = fork.Process(target=self._serve, args=(theirs, [a.pipe for a in (self, *others) if a.pipe is not None]), daemon=True)
        self.process.start()
        theirs.close()

    def _serve(self, pipe, callers: list) -> None:
        for p in callers:  # so that the caller's end is noticed
            p.close()
        while True:
            try:
                args = pipe.recv()
            except EOFError:
                return
            try:
                made = self.fn(**args)
                pipe.send((made, args["store"].to_dict() if "store" in args else None, None))
            except Exception as e:
                pipe.send((None, None, (type(e).__name__, str(e), getattr(e, "retryable", True))))

    def begin(self, args: dict[str, Any], others: list[Attempts]) -> None:
        if self.process is None or not self.process.is_alive():
            self.end()
            self._begin(others)
        self.pipe.send(args)

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = self.pipe = None

    def result(self, args: dict[str, Any]) -> Any:
        made, store, wrong = self.pipe.recv()
        if wrong is not None:
            name, message, retryable = wrong
            raise type(name, (Exception,), {"retryable": retryable})(message)
        if store is not None:
            args["store"].replace(store)
        return made

    def asleep(self) -> list[str] | None:
        """The CPU time of the process so far if it sleeps; None if it works or can't be looked at."""
        try:
            with open(f"/proc/{self.process.pid}/stat") as f:
                state, *rest = f.read().rpartition(")")[2].split()
        except OSError:
            return None
        return rest[10:14] if state == "S" else None


class Awaited:
    """What a run waits for: an attempt's result, until its limit; or the end of a pause."""

    def __init__(self, until: float, attempt: Attempts | None = None):
        self.until, self.attempt = until, attempt
        self.idle, self._spent, self._again = attempt is None, None, time.monotonic() + LOOK

    def leaves_time(self, now: float) -> bool:
        """Whether others may work meanwhile: in a pause, or if the attempt's process slept when it was last looked at and
        has not worked since the look before."""
        if self.attempt is not None and now >= self._again:
            spent = self.attempt.asleep()
            self.idle = spent is not None and spent == self._spent
            self._spent, self._again = spent, now + LOOK
        return self.idle


Steps = Generator[Awaited, bool, Any]


def side_by_side(runs: Iterable[Steps]) -> list[Any]:
    """The results of runs in their order. Each yields what it waits for and is sent whether that came in time. The next run
    begins when all that began and have not ended wait; while one of them works it has the task to itself, so that
    its time isn't used up by others."""
    todo, open_, made = enumerate(runs), {}, {}

    def step(i: int, run: Steps, said: bool | None) -> None:
        try:
            open_[i] = run, run.send(said)
        except StopIteration as end:
            open_.pop(i, None)
            made[i] = end.value

    while True:
        now = time.monotonic()
        if len(open_) < SIDE_BY_SIDE and all([a.leaves_time(now) for _, a in open_.values()]):
            following = next(todo, None)
            if following is not None:
                step(*following, None)
                continue
        if not open_:
            return [made[i] for i in range(len(made))]
        left = min(a.until for _, a in open_.values()) - now
        told = wait([a.attempt.pipe for _, a in open_.values() if a.attempt is not None], max(0.0, min(left, LOOK)))
        now = time.monotonic()
        for i, (run, a) in list(open_.items()):
            came = a.attempt is not None and a.attempt.pipe in told
            if came or now >= a.until:
                step(i, run, came)


def alone(run: Steps) -> Any:
    """The result of a run that waits for nothing but pauses."""
    said = None
    while True:
        try:
            time.sleep(max(0.0, run.send(said).until - time.monotonic()))
        except StopIteration as end:
            return end.value
        said = False


def packed(*values: Any) -> bytes:
    return pickle.dumps(values)


def unpacked(made: bytes) -> Any:
    return pickle.loads(made)


def by_row(*given) -> Callable:
    """A Python operator without a limit for one row (see `runner`)."""
    steps = runner(*given, [])
    return lambda *row: alone(steps(*row))


def by_batch(*given) -> Callable:
    """A Python operator with a limit for batches of packed rows, whose results are packed too (see `runner`). Its processes
    last as long as the task."""

    def results(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[Attempts] = []
        steps = runner(*given, held)
        try:
            for batch in batches:
                yield pa.array(map(pickle.dumps, side_by_side(steps(*pickle.loads(row)) for row in batch.to_pylist())), pa.binary())
        finally:
            for attempt in held:
                attempt.end()

    return results


def runner(fn, names, coded, outputs, retries, delay, limit, held: list[Attempts]) -> Callable[..., Steps]:
    """A Python operator for one row: dead rows give null; errors are retried with growing delay, unless they say
    `retryable = False`, then reported. deadline: when the row's run must have ended (seconds since 1970), if at all. held:
    the processes of its attempts."""
    free: list[Attempts] = []

    def once(args, deadline) -> Steps:
        left = None if deadline is None else deadline - time.time()
        if limit is None and left is None:
            return fn(**args)
        if left is not None and left <= 0:
            raise _Late
        if not free:
            free.append(Attempts(fn))
            held.append(free[0])
        attempt, most = free.pop(), min(x for x in (limit, left) if x is not None)
        try:
            attempt.begin(args, [a for a in held if a is not attempt])
            if (yield Awaited(time.monotonic() + most, attempt)):
                return attempt.result(args)
            attempt.end()
        finally:
            free.append(attempt)
        if left is not None and (limit is None or left <= limit):
            raise _Late
        raise TimeoutError(f"took over {round(most, 3):g} s")

    def plain(value, kind):
        return json.dumps(value) if isinstance(kind, T.StringType) and not isinstance(value, str) and value is not None else value

    def steps(live, deadline, *values) -> Steps:
        if not live:
            return None
        args = {n: json.loads(v).get("x") if n in coded and v is not None else v for n, v in zip(names, values, strict=True)}
        if "store" in args:
            args["store"] = FlowStore(args["store"] or {})
        errors: list[str] = []
        for attempt in range(retries + 1):
            try:
                made = yield from once(args, deadline)
                break
            except Exception as e:
                late = isinstance(e, _Late)
                errors.append(LATE if late else f"{type(e).__name__}: {e}")
                if late or not getattr(e, "retryable", True) or attempt == retries:
                    return {**dict.fromkeys(outputs), "live_": [], "fault_": errors[-1], "attempts_": attempt + 1, "errors_": errors}
                pause = delay * 2.0**attempt
                yield Awaited(time.monotonic() + (pause if deadline is None else max(0.0, min(pause, deadline - time.time()))))
        if isinstance(made, tuple):
            made = {f"output_{i}": v for i, v in enumerate(made, 1)}
        elif not (isinstance(made, dict) and set(made) >= set(outputs)):
            made = {"result": made}
        dead = [k for k, v in made.items() if v is SKIPPED]
        told = {"store_": args["store"].to_dict()} if "store" in args else {}
        return {**{k: None if k in dead else plain(made.get(k), kind) for k, kind in outputs.items()}, "live_": [k for k in outputs if k not in dead], "fault_": None, "attempts_": attempt + 1, "errors_": errors, **told}

    return steps


class _Late(Exception):
    """The run's deadline has passed."""


class FlowStore:
    """A run's side values, as text, that a Python operator with a `store` parameter reads and changes."""

    def __init__(self, held: dict[str, str]):
        self._held = dict(held)

    def set(self, key: str, value: Any) -> None:
        self._held[key] = value if isinstance(value, str) else json.dumps(value)

    def get(self, key: str, default: Any = None) -> Any:
        return self._held.get(key, default)

    def has(self, key: str) -> bool:
        return key in self._held

    def keys(self) -> list[str]:
        return list(self._held)

    def clear(self) -> None:
        self._held = {}

    def to_dict(self) -> dict[str, str]:
        return dict(self._held)

    def replace(self, held: dict[str, str]) -> None:
        self._held = dict(held)


class _Skipped:
    """What a Python operator returns for a handle that isn't taken."""

    def __bool__(self):
        return False

    def __reduce__(self):
        return "SKIPPED"


SKIPPED = _Skipped()
