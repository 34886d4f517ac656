"""Project tables: one wide Parquet table for each project, with columns added by keyed merges."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowsmith.operators.merge import enrich
from rowsmith.operators.reshape import unpivot_counts
from rowsmith.operators.rules import apply_filters


class Conflict(RuntimeError):
    """Another writer has committed a version since the one that this was made from."""


class ProjectTable:
    """A table under ``root``: folders of versions, and commits, numbered from 0, that name them.

    A save writes a whole new version first and then makes the next commit by moving a finished file to its number, which
    fails if that number is taken. So a reader sees whole versions only, a crash in between leaves the table as it was,
    and of two writers of the same number one learns that it was not the first. Readers of an old version are not
    disturbed, and a table can be saved from a plan that reads it.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{name}"

    def _hadoop(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        hadoop = self._hadoop().Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def last(self) -> int | None:
        """The number of the last commit."""
        fs, path = self._fs(f"{self.base}/commits")
        if not fs.exists(path):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def _commit(self, number: int) -> dict:
        fs, path = self._fs(f"{self.base}/commits/{number:012d}")
        with_end = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_end, "UTF-8"))
        finally:
            with_end.close()

    def exists(self) -> bool:
        return self.last() is not None

    def _version(self) -> str:
        at = self.last()
        if at is None:
            raise FileNotFoundError(f"no project table at {self.base}")
        return self._commit(at)["version"]

    def notes(self, number: int | None) -> dict:
        """What was saved with a commit beside its rows."""
        return {} if number is None else self._commit(number)["notes"]

    def load(self, columns: Sequence[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.base}/{self._version()}")
        return df if columns is None else df.select(*columns)

    def _publish(self, number: int, commit: dict) -> bool:
        """Make commit ``number``; False if it is there already."""
        fs, part = self._fs(f"{self.base}/commits/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self._hadoop().FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(part), fs.makeQualified(self._hadoop().Path(f"{self.base}/commits/{number:012d}")), how)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(part, False)
            return False

    def save(self, df: DataFrame, notes: dict | None = None, after: int | None = -1) -> bool:
        """Save a version. With ``after``, the number of the commit that ``df`` was made from (None: of no table), only if none has come since; whether it was saved."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.base}/{version}")
        while True:
            last = self.last() if after == -1 else after
            if self._publish(0 if last is None else last + 1, {"version": version, "notes": notes or {}}):
                return True
            if after != -1:
                return False

    def describe(self) -> dict:
        """Rows, columns and types of the table, also written as JSON beside it."""
        df = self.load()
        found = {"version": self._version(), "rows": df.count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}}
        self.spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.base}/metadata")
        return found

    def add_columns(self, df: DataFrame, key: str, prefer: str = "new", tries: int = 10) -> None:
        """Merge columns in by key; where another writer comes first, again from its version."""
        for _ in range(tries):
            at = self.last()
            if self.save(enrich(self.load(), df, key, prefer), self.notes(at), after=at):
                return
        raise Conflict(f"{tries} other commits at {self.base}")

    def export(self, path: str, filters: dict[str, object] | None = None, columns: Sequence[str] | None = None) -> int:
        """Rows written. Filter first, then project, so that a filter's column need not be exported."""
        df = apply_filters(self.load(), filters or {})
        return export_csv(df if columns is None else df.select(*columns), path)

    def profile(self) -> DataFrame:
        return unpivot_counts(self.load())


def projects(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables under ``root``, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/commits")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    return sorted(f.getPath().getParent().getName() for f in found)


def export_csv(df: DataFrame, path: str, mark: bool = False) -> int:
    """Write a CSV with a header, under a byte order mark if asked for, and count its rows in the same pass."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def export_stamped(df: DataFrame, root: str, stamp: str) -> list[str]:
    """A copy under a time stamp and one under ``latest``, both with a byte order mark; written once, then read."""
    stamped = f"{root.rstrip('/')}/{stamp}"
    export_csv(df, stamped, mark=True)
    df.sparkSession.read.option("header", True).csv(stamped).write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/latest")
    return [stamped, f"{root.rstrip('/')}/latest"]


def export_sample(df: DataFrame, path: str, order_by: Sequence[str], n: int = 100) -> int:
    """The first ``n`` rows by an order."""
    return export_csv(df.orderBy(*order_by).limit(n), path)


def export_outcomes(df: DataFrame, path: str, success, form: str = "json") -> None:
    """``success``, ``failed`` and ``combined`` below ``path``; a null condition is a failure."""
    marked = df.withColumn("success", F.coalesce(success, F.lit(False)))
    marked.write.mode("overwrite").format(form).option("header", True).save(f"{path}/combined")
    for name, rows in (("success", marked.filter("success")), ("failed", marked.filter("not success"))):
        rows.drop("success").write.mode("overwrite").format(form).option("header", True).save(f"{path}/{name}")


def export_segments(df: DataFrame, path: str, by: str, form: str = "csv") -> None:
    """One folder for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).format(form).save(path)
