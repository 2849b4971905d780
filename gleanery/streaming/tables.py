"""Tables kept current by a stream.

Each micro-batch writes its own folder ``run=N-N``, replacing it when the batch is run again after a failure, so a replay
leaves the same table. Every ``fan_in`` batches are folded into one run, every ``fan_in`` of those into a larger one, and so on:
a reader meets a logarithmic number of runs, a row is written again a logarithmic number of times, and no batch pays for the
history. Runs that a larger one replaced are removed ``keep`` batches later, when no replay or reader can still want them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Field, explode_postings, forward_index
from ..operators.maintain import last_per_key
from ..session import settle


@dataclass(frozen=True)
class Runs:
    """The folders ``run=A-B`` of a table: what batches A to B left, once complete."""

    spark: SparkSession
    path: str
    schema: str
    fan_in: int = 8
    keep: int = 16

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def complete(self) -> list[tuple[int, int]]:
        """All runs with a success marker, replaced ones included, by first batch, larger ones first."""
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = []
        for status in fs.listStatus(path(self.path)):
            name = status.getPath().getName()
            if name.startswith("run=") and fs.exists(path(status.getPath(), "_SUCCESS")):
                first, last = name[4:].split("-")
                found.append((int(first), int(last)))
        return sorted(found, key=lambda r: (r[0], -r[1]))

    def live(self, before: int | None = None) -> list[tuple[int, int]]:
        """The runs a reader needs, oldest first; those inside a larger one are left out."""
        out: list[tuple[int, int]] = []
        for run in self.complete():
            if (before is None or run[1] < before) and (not out or run[0] > out[-1][1]):
                out.append(run)
        return out

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(r) for r in runs])

    def write(self, rows: DataFrame, epoch: int, fold: Callable[[list[tuple[int, int]]], DataFrame]) -> None:
        """Write one batch, fold the runs that are due, remove those replaced long ago."""
        rows.write.mode("overwrite").parquet(self._folder((epoch, epoch)))
        span = self.fan_in
        while (epoch + 1) % (span * self.fan_in) == 0:
            span *= self.fan_in
        if (epoch + 1) % span == 0:
            self.fold(fold, first=epoch + 1 - span, last=epoch)
        self._retire(epoch)

    def fold(self, fold: Callable[[list[tuple[int, int]]], DataFrame], first: int = 0, last: int | None = None) -> None:
        """Replace the live runs between two batches by one."""
        due = [r for r in self.live() if r[0] >= first and (last is None or r[1] <= last)]
        if len(due) > 1:
            fold(due).write.mode("overwrite").parquet(self._folder((due[0][0], due[-1][1])))

    def _retire(self, epoch: int) -> None:
        complete, live = self.complete(), set(self.live())
        path, fs = self._fs()
        for run in complete:
            cover = min((r[1] for r in complete if r != run and r[0] <= run[0] and r[1] >= run[1]), default=None)
            if run not in live and cover is not None and cover + self.keep <= epoch:
                fs.delete(path(self._folder(run)), True)


@dataclass(frozen=True)
class ChangeTable:
    """A keyed table as runs of changes, the oldest of which is in effect the base.

    Change rows are the table's columns with ``op`` (``upsert`` / ``delete``) and an arrival number ``seq``. A key keeps the change
    with the highest arrival number, then the later batch: a change that comes late does not undo a newer one. For that the runs
    keep arrival numbers and deletes. Where no change comes more than ``horizon`` arrival numbers late, folding everything drops the
    deletes that lie further back than that.
    """

    spark: SparkSession
    path: str
    key: str
    schema: str
    horizon: int | None = None
    fan_in: int = 8
    keep: int = 16

    @property
    def runs(self) -> Runs:
        return Runs(self.spark, self.path, self.schema + ", op string, seq long, epoch long", self.fan_in, self.keep)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Write the last operation per key of one batch."""
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows = last_per_key(batch, self.key, ["seq"]).withColumn("epoch", F.lit(epoch).cast("long"))
        self.runs.write(rows.select(*columns, "op", "seq", "epoch"), epoch, self._fold)

    def changes(self, after: int = -1) -> DataFrame:
        """The last change per key of each run that begins after a batch."""
        return self.runs.read([r for r in self.runs.live() if r[0] > after])

    def _fold(self, runs: list[tuple[int, int]]) -> DataFrame:
        """The last change of every key, deletes included. Only keys that changed since the oldest run are compared with it, so that a
        base of any size stays where it is."""
        last = last_per_key(self.runs.read(runs[1:]), self.key, ["seq", "epoch"])
        base = self.runs.read(runs[:1])
        newer = base.join(last.select(self.key, F.col("seq").alias("_seq")), self.key).filter(F.col("seq") > F.col("_seq")).select(self.key)
        won = settle(last.join(newer, self.key, "left_anti"))
        rows = base.join(won.select(self.key), self.key, "left_anti").unionByName(won.select(*base.columns))
        if self.horizon is None or runs[0] != self.runs.live()[0]:
            return rows
        newest = self.runs.read(runs).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        return rows.filter((F.col("op") != "delete") | (F.col("seq") >= newest - self.horizon))

    def current(self) -> DataFrame:
        """The rows whose last change is not a delete."""
        live = self.runs.live()
        rows = self._fold(live) if len(live) > 1 else self.runs.read(live)
        return rows.filter("op <> 'delete'").drop("op", "seq", "epoch")

    def compact(self) -> None:
        """Fold all changes so far into one run."""
        self.runs.fold(self._fold)


def stream_upsert_delete(changes: DataFrame, table: ChangeTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of changes; each key keeps the one with the highest arrival number, whatever batch it comes in."""
    return (changes.writeStream.foreachBatch(lambda df, epoch: table.apply(df, epoch))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


@dataclass(frozen=True)
class SeenTable:
    """Values a stream met, each written once, in the batch that met it first. The stream's own keyed state knows what was met
    (:func:`gleanery.streaming.stream_new_urls`), so a batch never reads the table."""

    spark: SparkSession
    path: str
    column: str
    fan_in: int = 8
    keep: int = 16

    @property
    def runs(self) -> Runs:
        return Runs(self.spark, self.path, f"{self.column} string", self.fan_in, self.keep)

    def apply(self, new: DataFrame, epoch: int) -> None:
        """Add values that no earlier batch held. A batch that is run again replaces its own folder."""
        self.runs.write(new.select(self.column), epoch, self.runs.read)

    def current(self) -> DataFrame:
        return self.runs.read(self.runs.live())


@dataclass(frozen=True)
class StatisticsTable:
    """Term statistics as partial sums per run, added up on read."""

    spark: SparkSession
    path: str
    fields: tuple[Field, ...]
    key: str = "doc_id"
    fan_in: int = 8
    keep: int = 16

    @property
    def runs(self) -> Runs:
        return Runs(self.spark, self.path, "field string, term string, df long, cf double", self.fan_in, self.keep)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        postings = explode_postings(forward_index(batch, self.fields, self.key))
        self.runs.write(postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf")), epoch, self._sum)

    def _sum(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.runs.read(runs).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def current(self) -> DataFrame:
        return self._sum(self.runs.live())


def stream_term_stats(documents: DataFrame, table: StatisticsTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep df and cf current while documents arrive (append-only)."""
    return (documents.writeStream.foreachBatch(lambda df, epoch: table.apply(df, epoch))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
