"""A store of revisions on files that a stream writes: each batch is seen whole or not at all, and clearing has two phases.

A batch writes its accepted rows, then the newest revision of every key (heads). The heads are the commit: Spark marks a
written folder by a file of its own, so a batch that dies between the two leaves rows that nobody reads, and running it
again replaces them. Heads also say up to which revision a key is cleared. A clear is thus in force when its heads are
written (first phase); purge() then takes the rows away (second phase), one batch at a time by writing what stays beside
it and renaming. recover() ends what was begun, so a crash anywhere leaves the old state or the new one. A batch reads the
heads of the batch before it, not the rows of all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import sessions

ROWS, HEADS = "key string, seq long, revision long, body string", "key string, revision long, cleared long"


class Store:
    """folder/rows/batch=N and folder/heads/batch=N; .new behind a name: written, not yet in its place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch:012d}"

    def _written(self, path: str) -> bool:
        return self._files.exists(self._path(f"{path}/_SUCCESS"))

    def _batches(self, kind: str) -> list[int]:
        """Numbers of the batches that are written to their end."""
        top = self._path(f"{self.folder}/{kind}")
        names = [x.getPath().getName() for x in self._files.listStatus(top)] if self._files.exists(top) else []
        return sorted(n for n in (int(x.removeprefix("batch=").removesuffix(".new")) for x in set(names) if x.startswith("batch=") and not x.endswith(".new")) if self._written(self._at(kind, n)))

    def _move(self, path: str) -> None:
        """path.new to path."""
        self._files.delete(self._path(path), True)
        if not self._files.rename(self._path(f"{path}.new"), self._path(path)):
            raise OSError(f"{path}.new could not be renamed")

    def heads(self, below: int | None = None) -> DataFrame:
        """(key, revision, cleared) as of the newest batch, or of the newest below a number."""
        known = [n for n in self._batches("heads") if below is None or n < below]
        return self.spark.read.schema(HEADS).parquet(self._at("heads", known[-1])) if known else self.spark.createDataFrame([], HEADS)

    def swap(self, writes: DataFrame, batch: int) -> None:
        """foreachBatch sink of writes (key, seq, expected, body): accepted ones are the next revision of their key.

        A body of null is a clear: it is a revision like any other, and no row up to it is left. A batch that is run
        again begins from the same heads and gives the same result.
        """
        before = self.heads(batch)
        based = writes.join(before.withColumnRenamed("revision", "base"), "key", "left").na.fill(0, ["base", "cleared"])
        asked = based.select("key", "seq", (F.col("expected") - F.col("base")).alias("expected"))
        accepted = sessions.compare_and_swap(asked).where("accepted").drop("accepted")
        kept = based.join(accepted, ["key", "seq"]).select("key", "seq", (F.col("base") + F.col("revision")).alias("revision"), "body")
        kept.write.mode("overwrite").parquet(self._at("rows", batch))
        now = self.spark.read.schema(ROWS).parquet(self._at("rows", batch))
        new = now.groupBy("key").agg(F.max("revision").alias("_now"), F.max(F.when(F.col("body").isNull(), F.col("revision"))).alias("_clear"))
        joined = before.join(new, "key", "full").select("key", F.coalesce("_now", "revision").alias("revision"), F.coalesce("_clear", "cleared", F.lit(0)).alias("cleared"))
        joined.write.mode("overwrite").parquet(self._at("heads", batch))

    def _rows(self) -> DataFrame:
        committed = set(self._batches("heads"))
        paths = [self._at("rows", n) for n in self._batches("rows") if n in committed]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def stored(self) -> DataFrame:
        """(key, seq, revision, body) of all committed revisions that aren't cleared."""
        return self._rows().join(self.heads().select("key", "cleared"), "key").where("revision > cleared").select("key", "seq", "revision", "body")

    def purge(self) -> int:
        """The second phase: takes away rows that are cleared, and heads that newer ones replace; how many batches changed."""
        cleared, changed = self.heads().select("key", "cleared").where("cleared > 0"), 0
        for n in self._batches("rows"):
            rows = self.spark.read.schema(ROWS).parquet(self._at("rows", n)).join(cleared, "key", "left")
            gone = F.coalesce(F.col("revision") <= F.col("cleared"), F.lit(False))
            if n in self._batches("heads") and not rows.where(gone).isEmpty():
                rows.where(~gone).drop("cleared").write.mode("overwrite").parquet(f"{self._at('rows', n)}.new")
                self._move(self._at("rows", n))
                changed += 1
        for n in self._batches("heads")[:-2]:  # the last one's predecessor is what it is made from again
            self._files.delete(self._path(self._at("heads", n)), True)
            self._files.mkdirs(self._path(self._at("heads", n)))
            self._files.create(self._path(f"{self._at('heads', n)}/_SUCCESS")).close()  # committed, its heads not needed
        return changed

    def recover(self) -> None:
        """After a crash: puts in its place what was written to its end, and drops the rest of what was begun."""
        top = self._path(f"{self.folder}/rows")
        for x in self._files.listStatus(top) if self._files.exists(top) else []:
            name = x.getPath().getName()
            if name.endswith(".new"):
                if self._written(f"{self.folder}/rows/{name}"):
                    self._move(f"{self.folder}/rows/{name.removesuffix('.new')}")
                else:
                    self._files.delete(x.getPath(), True)
