"""Functions from outside the engine: subprocess line pipelines, Arrow maps, device work splits, job graphs."""

from __future__ import annotations

import math
import shlex
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.operators.project import split_first


def subprocess_lines(command: str | list[str], env: dict[str, str] | None = None, check: bool = True):
    """An Arrow function: one process per partition; lines in on stdin, lines out of stdout. Lines that the process
    writes to stderr as ``reporter:counter:group,name,amount`` are summed and returned as rows of kind 'counter'."""
    argv = shlex.split(command) if isinstance(command, str) else command

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import threading

        process = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env={**os.environ, **(env or {})})
        counts: dict[str, int] = {}

        def feed() -> None:
            try:
                for b in batches:
                    for line in b.column(0).to_pylist():
                        process.stdin.write((line or "").encode() + b"\n")
                process.stdin.close()
            except BrokenPipeError:
                pass

        def listen() -> None:
            for raw in process.stderr:
                text = raw.decode("utf-8", "replace").strip()
                if text.startswith("reporter:counter:"):
                    name, _, amount = text[len("reporter:counter:") :].rpartition(",")
                    counts[name] = counts.get(name, 0) + int(amount)

        threads = [threading.Thread(target=t, daemon=True) for t in (feed, listen)]
        for t in threads:
            t.start()
        out: list[str] = []
        pack = lambda kind, lines: pa.RecordBatch.from_arrays([pa.array([kind] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["kind", "line"])
        for raw in process.stdout:
            out.append(raw.decode("utf-8", "replace").rstrip("\n"))
            if len(out) >= 10_000:
                yield pack("line", out)
                out = []
        code = process.wait()
        for t in threads:
            t.join()
        if check and code:
            raise RuntimeError(f"{argv[0]} ended with {code}")
        yield pack("line", out)
        yield pack("counter", [f"{k},{v}" for k, v in counts.items()])

    return run


def command_output(df: DataFrame, line_col: str, command: str | list[str], **options) -> DataFrame:
    """(kind, line): the output lines of a command and what it counted, from one run."""
    return df.select(F.col(line_col).cast("string")).mapInArrow(subprocess_lines(command, **options), "kind string, line string")


def command_counters(output: DataFrame) -> DataFrame:
    """(counter_group, counter, n): the counters in :func:`command_output`, summed over all processes."""
    each = output.where("kind = 'counter'")
    parts = F.split("line", ",")
    return each.groupBy(parts[0].alias("counter_group"), parts[1].alias("counter")).agg(F.sum(parts[2].cast("long")).alias("n"))


def map_command(df: DataFrame, line_col: str, command: str | list[str], key_fields: int = 1, separator: str = "\t", **options) -> DataFrame:
    """(key, value) of a streaming mapper's output lines; the first ``key_fields`` fields are the key."""
    return command_pairs(command_output(df, line_col, command, **options), key_fields, separator)


def command_pairs(output: DataFrame, key_fields: int = 1, separator: str = "\t") -> DataFrame:
    """(key, value) of the lines in :func:`command_output`."""
    out = output.where("kind = 'line'")
    if key_fields == 1:
        key, value = split_first(F.col("line"), separator)
    else:
        key = F.substring_index("line", separator, key_fields)
        value = F.substring(F.col("line"), F.length(key) + len(separator) + 1, F.length("line"))
    return out.select(key.alias("key"), value.alias("value"))


def reduce_command(pairs: DataFrame, command: str | list[str], separator: str = "\t", **options) -> DataFrame:
    """(key, value): a streaming reducer; each process sees its keys together and in order, so a key's rows go through one
    process, line by line."""
    lines = pairs.repartition("key").sortWithinPartitions("key", "value").select(F.concat_ws(separator, "key", "value").alias("line"))
    return map_command(lines, "line", command, separator=separator, **options)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A native map on Arrow batches."""
    return df.mapInArrow(lambda batches: map(function, batches), schema)


def threaded_map(df: DataFrame, function: Callable[[dict], dict], schema: str, threads: int = 10) -> DataFrame:
    """A map of rows by several threads a task, for functions that wait on something else; rows keep their order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                yield pa.RecordBatch.from_pylist(list(pool.map(function, b.to_pylist())), schema=kind)

    return df.mapInArrow(work, schema)


def arrow_reduce(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """A general reducer: a function of the rows of each key, which must fit in a task."""
    return df.groupBy(*keys).applyInArrow(function, schema)


def user_aggregate(df: DataFrame, keys: list[str], partial: Callable[[pa.Table], pa.Table], merge: Callable[[pa.Table], pa.Table], schema: str, partial_schema: str) -> DataFrame:
    """An aggregate of one's own by decomposition: ``partial`` folds each batch before the shuffle, ``merge`` the few
    folds of a key, so a key may have any number of rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from partial(pa.Table.from_batches([b])).to_batches()

    return df.mapInArrow(fold, partial_schema).groupBy(*keys).applyInArrow(merge, schema)


def user_table(df: DataFrame, columns: list[str], function: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """A table function of one's own: any number of rows for each input row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [dict(zip(kind.names, out)) for r in zip(*(c.to_pylist() for c in b.columns)) for out in function(*r)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return df.select(*columns).mapInArrow(work, schema)


def on_device(df: DataFrame, function: Callable, schema: str, resource: str | None = None, amount: int = 1) -> DataFrame:
    """An Arrow map under a resource profile that asks for a device, if one is named; the results are the same."""
    if resource is None:
        return df.mapInArrow(function, schema)
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(ExecutorResourceRequests().resource(resource, amount)).require(TaskResourceRequests().resource(resource, amount)).build
    return df.mapInArrow(function, schema, profile=profile)


def split_work(pending: int, n_cpu: int, n_gpu: int, alpha: float) -> tuple[int, int]:
    """Tasks for CPU and GPU slots that end soonest, if a CPU task takes ``alpha`` times as long (0: unknown)."""
    if not n_gpu:
        return pending, 0
    if not n_cpu:
        return 0, pending
    if alpha <= 0:
        x = pending * n_cpu // (n_cpu + n_gpu)
        return x, pending - x
    return min(((x, pending - x) for x in range(pending + 1)), key=lambda p: (max(math.ceil(p[0] / n_cpu) * alpha, math.ceil(p[1] / n_gpu)), p[0]))


class JobGraph:
    """Named jobs with dependencies, run in order; a job whose dependency failed is not run."""

    def __init__(self) -> None:
        self.jobs: dict[str, tuple[Callable[[], object], tuple[str, ...]]] = {}
        self.state: dict[str, str] = {}
        self.results: dict[str, object] = {}

    def add(self, name: str, job: Callable[[], object], *after: str) -> None:
        self.jobs[name] = (job, after)
        self.state[name] = "waiting"

    def run(self) -> dict[str, str]:
        while ready := [n for n, s in self.state.items() if s == "waiting" and all(self.state.get(d) == "success" for d in self.jobs[n][1])]:
            for n in ready:
                try:
                    self.results[n] = self.jobs[n][0]()
                    self.state[n] = "success"
                except Exception as e:  # the graph reports it
                    self.state[n], self.results[n] = "failed", e
        for n, s in self.state.items():
            if s == "waiting":
                self.state[n] = "dependent failed"
        return dict(self.state)
