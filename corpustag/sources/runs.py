"""Tables that grow by runs: a run's rows are written once, however often the run is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunTable:
    """Rows by run, with the run's number as the column ``run``.

    A run's rows lie in a folder of its number, which a repetition overwrites; what is read before a run is that of smaller numbers
    only. So it comes to the same whether a run happens once or twice. Every ``fold_every`` runs, ``fold`` makes one folder of
    all earlier ones, so that what is read grows with what the table says, not with the runs; runs from before the last
    fold are not to be repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, fold: Callable[[DataFrame], DataFrame], fold_every: int = 100):
        self.spark, self.folder, self.fold, self.fold_every = spark, folder.rstrip("/"), fold, fold_every
        self.schema = f"{schema}, run bigint"

    def rows(self, before: int | None = None) -> DataFrame:
        """The rows of all runs, or of those before ``before``."""
        parts = [f"{self.folder}/{name}" for name in self._parts(before)]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def record(self, rows: DataFrame, run: int) -> None:
        """Write a run's rows."""
        names = [f.strip().split()[0] for f in self.schema.split(",")]
        rows.withColumn("run", F.lit(run).cast("bigint")).select(*names).write.mode("overwrite").parquet(f"{self.folder}/run={run}")
        if run and run % self.fold_every == 0:
            self.fold(self.rows(run)).select(*names).write.mode("overwrite").parquet(f"{self.folder}/fold={run}")

    def next_run(self) -> int:
        """A number no finished run has."""
        return max((int(name.split("=")[1]) + name.startswith("run") for name in self._parts(None)), default=0)

    def _parts(self, before: int | None) -> list[str]:
        """The newest finished fold and the finished runs from it on, below ``before``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        place = path(self.folder)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        names = [f.getPath().getName() for f in system.listStatus(place)]
        whole = [n for n in names if system.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        numbers = lambda kind: sorted(int(n.split("=")[1]) for n in whole if n.startswith(kind + "="))
        folds = [n for n in numbers("fold") if before is None or n <= before][-1:]
        return [f"fold={n}" for n in folds] + [
            f"run={n}" for n in numbers("run") if n >= (folds or [0])[0] and (before is None or n < before)]


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by run and ``order``."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(rest, F.struct("run", *order)).alias("_last")).select(key, "_last.*")
