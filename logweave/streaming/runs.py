"""Micro-batches written under their run and batch number, and a log of what is committed.

A run is one streaming query with its checkpoint: its id lives in the
checkpoint, so a restarted query keeps it and a query with a new checkpoint
gets a new one.  Batch N of run R owns the partitions ``run=R/batch=N`` of the
target; no other run, stream or batch job touches them.

A batch counts once its line stands in the target's ``_commits`` folder, written
after its rows, as one file.  Readers read committed batches only, so half a batch
that a crash left behind is never seen; its replay rewrites those partitions.  A
batch that is committed already is not written again.

``compact`` folds the small batches into one set of larger files and commits the
new files and the end of the old ones in one line-up, so that readers see the one
or the other; ``vacuum`` removes what nobody reads any more.  A table without a
commit log (written by something else) is read whole.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches ``first`` to ``last`` of ``run`` are committed; their rows are their own,
#: or, with ``home``, among those of that folded run.
COMMIT = T.StructType().add("run", "string").add("first", "long").add("last", "long").add("home", "string") \
    .add("buckets", "integer")
FOLD = "fold-"
Ranges = dict[str, list[tuple[int, int]]]


def start_batches(stream: DataFrame, write: Callable[[DataFrame, str, int], None], checkpoint: str,
                  available_now: bool, interval: str):
    """Start a query that calls ``write(batch, run, batch number)`` for each micro-batch."""
    known, run = threading.Event(), []

    def each(batch: DataFrame, number: int) -> None:
        known.wait()
        write(batch, run[0], number)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    query = w.start()
    run.append(query.id)
    known.set()
    return query


# ------------------------------------------------------------- commit log ---

@dataclass(frozen=True)
class Commits:
    """Batch ranges per run: those whose own rows are read (``live``), all that are
    stored (``known``), and the number of key buckets of a keyed table."""
    live: Ranges
    known: Ranges
    buckets: int | None = None

    def holds(self, run: str, number: int) -> bool:
        return any(a <= number <= b for a, b in self.known.get(run, ()))

    def read(self, only: Ranges | None = None) -> Column:
        """Predicate on ``run`` and ``batch`` (partition columns) of the rows to read."""
        out = F.lit(False)
        for run, ranges in (self.live if only is None else only).items():
            for a, b in ranges:
                same = F.col("batch") == a if a == b else F.col("batch").between(a, b)
                out = out | ((F.col("run") == run) & same)
        return out


def _union(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        elif a <= b:
            out.append((a, b))
    return out


def _without(ranges: list[tuple[int, int]], gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    for c, d in gone:
        ranges = [x for a, b in ranges for x in ((a, min(b, c - 1)), (max(a, d + 1), b)) if x[0] <= x[1]]
    return ranges


def commits(spark: SparkSession, target: str) -> Commits | None:
    """The commit log of a table; None if it has none.  Its lines are one a batch
    since the last ``vacuum``, which merges them into ranges."""
    if not _files(spark, target)[1]("_commits"):
        return None
    rows = spark.read.schema(COMMIT).json(f"{target}/_commits").collect()
    own: dict = {}
    folded: dict = {}
    for r in rows:
        (own if r["home"] is None else folded).setdefault(r["run"], []).append((r["first"], r["last"]))
    known = {run: _union([*own.get(run, []), *folded.get(run, [])]) for run in {*own, *folded}}
    live = {run: left for run, x in own.items() if (left := _without(_union(x), folded.get(run, [])))}
    return Commits(live, {k: v for k, v in known.items() if v}, max((r["buckets"] or 0 for r in rows), default=0) or None)


def commit(spark: SparkSession, target: str, lines: list[tuple], buckets: int | None = None) -> None:
    """Add lines (run, first, last, home) to the log as one file: all or none of them."""
    spark.createDataFrame([(*x, buckets) for x in lines], COMMIT).coalesce(1) \
        .write.mode("append").json(f"{target}/_commits")


# ------------------------------------------------------------------ batches ---

def write_batch(rows: DataFrame, target: str, run: str, number: int, by: tuple[str, ...] = (),
                lead: tuple[str, ...] = (), buckets: int | None = None) -> bool:
    """Write the rows of one batch of one run and commit them; False if they are
    committed already.  ``lead`` and ``by`` are partition columns above and below."""
    spark = rows.sparkSession
    log = commits(spark, target)
    if log is None:         # from now on readers look for commits
        commit(spark, target, [("", 0, -1, None)], buckets)
    elif log.holds(run, number):
        return False
    _write(rows, target, run, number, by, lead)
    commit(spark, target, [(run, number, number, None)], buckets)
    return True


def _write(rows: DataFrame, target: str, run: str, number: int, by: tuple[str, ...], lead: tuple[str, ...]) -> None:
    (rows.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*lead, "run", "batch", *by).parquet(target))


def _read(spark: SparkSession, target: str, schema: T.StructType, by: tuple[str, ...], lead: tuple[str, ...],
          below: str = "") -> DataFrame | None:
    """The files of a table, or of those of its folders that ``below`` (a glob) names; None if there are none."""
    extra = [*[T.StructField(c, T.IntegerType()) for c in lead], T.StructField("run", T.StringType()),
             T.StructField("batch", T.LongType()), *[T.StructField(c, T.StringType()) for c in by]]
    if not _files(spark, target)[1](below or "."):
        return None
    reader = spark.read.schema(T.StructType([*schema.fields, *extra])).option("basePath", target)
    return reader.parquet(f"{target}/{below}" if below else target)


def read_batches(spark: SparkSession, target: str, schema: T.StructType, by: tuple[str, ...] = (),
                 lead: tuple[str, ...] = (), only: Iterable[int] | None = None) -> DataFrame | None:
    """All committed rows with their ``run`` and ``batch``; None while there are none.
    ``only`` reads these values of the first ``lead`` column and lists no other folder."""
    below = "" if only is None else f"{lead[0]}={{{','.join(map(str, sorted(only)))}}}"
    log = commits(spark, target)
    if log is not None and not log.live:
        return None
    rows = _read(spark, target, schema, by, lead, below)
    return rows if rows is None or log is None else rows.where(log.read())


def compact(spark: SparkSession, target: str, schema: T.StructType, by: tuple[str, ...] = (),
            lead: tuple[str, ...] = (), least: int = 2,
            merge: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Fold the table's single batches, if there are ``least`` or more, into one set
    of files of a good size; returns how many were folded.  Earlier folds stay as
    they are, so a row is rewritten once.  ``merge`` may add up rows that allow it.
    Batches that are committed meanwhile are left for the next time.  One
    compaction of a table runs at a time."""
    log = commits(spark, target)
    small = {} if log is None else {k: v for k, v in log.live.items() if not k.startswith(FOLD)}
    number = sum(b - a + 1 for x in small.values() for a, b in x)
    if number < least:
        return 0
    rows = _read(spark, target, schema, by, lead)
    home = FOLD + uuid.uuid4().hex
    lines = [(run, a, b, home) for run, x in small.items() for a, b in x]
    if rows is not None:
        rows = rows.where(log.read(small)).drop("run", "batch")
        rows = merge(rows) if merge else rows
        _write(rows.hint("rebalance", *[F.col(c) for c in (*lead, *by)]), target, home, 0, by, lead)
    commit(spark, target, [(home, 0, 0, None), *lines], log.buckets)
    return number


def _files(spark: SparkSession, target: str):
    """Hadoop's file system of a table, and a glob below it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, lambda glob: [s.getPath() for s in (fs.globStatus(path(f"{target}/{glob}")) or ())]


def remove(spark: SparkSession, target: str, glob: str, which: Callable[[str], bool]) -> int:
    """Remove the folders below ``target`` that match ``glob`` and whose name ``which`` accepts."""
    fs, found = _files(spark, target)
    return sum(bool(fs.delete(p, True)) for p in found(glob) if which(p.getName()))


def vacuum(spark: SparkSession, target: str) -> int:
    """Remove folders of folded batches and merge the lines of the commit log; returns
    the folders removed.  For times when no reader still uses an older view."""
    fs, found = _files(spark, target)
    old = found("_commits/part-*")      # listed before they are read: a later commit is not among them
    log = commits(spark, target)
    if log is None:
        return 0
    removed = 0
    gone = [(run, a, b) for run, x in log.known.items() for a, b in _without(x, log.live.get(run, []))]
    for run, first, last in gone:
        for a in range(first, last + 1, 100):
            batches = "{" + ",".join(str(n) for n in range(a, min(a + 100, last + 1))) + "}"
            for path in found(f"run={run}/batch={batches}") + found(f"*/run={run}/batch={batches}"):
                removed += bool(fs.delete(path, True))
    lines = [(run, a, b, None) for run, x in log.live.items() for a, b in x] + [(*x, "gone") for x in gone]
    commit(spark, target, lines or [("", 0, -1, None)], log.buckets)
    for path in old:
        fs.delete(path, False)
    return removed
