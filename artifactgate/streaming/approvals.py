"""Approvals and deny lists kept up to date from a stream of scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from artifactgate.operators import approve


class Approvals:
    """The last state of each digest, replaced by every micro-batch; ``apply`` is a foreachBatch function.

    States are tables in a folder, named by the epoch that wrote them, so that a
    stream that starts again from its checkpoint finds what it knew. A batch that
    is delivered again is applied to the state before it, and the state is a max
    over (ts, scan_id) in any case: it changes nothing. The state before the last
    is kept, older ones go.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, epoch: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epoch-{epoch}")

    def _fs(self):
        return self._path(0).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def epochs(self) -> list[int]:
        """The epochs whose state has been written whole."""
        fs, root = self._fs(), self._path(0).getParent()
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        every = [int(n.removeprefix("epoch-")) for n in names if n.startswith("epoch-")]
        return sorted(e for e in every if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(e), "_SUCCESS")))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        own = approve.acting(batch).select("digest", "ts", "scan_id", "approved")
        before = [e for e in self.epochs() if e < epoch]
        known = self.spark.read.parquet(f"{self.folder}/epoch-{before[-1]}") if before else own.limit(0)
        approve.upserted(known, own).write.mode("overwrite").parquet(f"{self.folder}/epoch-{epoch}")
        for e in before[:-1]:
            self._fs().delete(self._path(e), True)

    @property
    def state(self) -> DataFrame | None:
        """(digest, ts, scan_id, approved) as the last batch left it."""
        known = self.epochs()
        return self.spark.read.parquet(f"{self.folder}/epoch-{known[-1]}") if known else None

    def current(self) -> DataFrame | None:
        return None if self.state is None else self.state.where("approved").select("digest")


def denied_in_batch(feed: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads the deny list anew for each batch, so a changed feed takes effect at once."""

    def apply(batch: DataFrame, epoch: int) -> None:
        sink(batch.join(feed(), "digest", "left_semi"), epoch)

    return apply
