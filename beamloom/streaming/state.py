"""Small numbered documents and sums in the shared folder: what a live job remembers between batches.

Both are safe from a batch that runs twice: what a number says is written whole, under that number, and nothing a batch
reads or writes grows with the number of batches before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a store of sums that wait beside the base before they are merged into it.
PARTS = 16


class Files:
    """The shared file system, as Spark's own readers see it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self._path("/".join([self.folder, *names]))

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.at(*names))

    def names(self, *names: str) -> list[str]:
        p = self.at(*names)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def remove(self, *names: str) -> None:
        self.fs.delete(self.at(*names), True)


class Numbered:
    """Documents 0, 1, 2, ...; the newest ``keep`` stay (None: all)."""

    def __init__(self, spark: SparkSession, folder: str, keep: int | None = None):
        self.files, self.keep = Files(spark, folder), keep

    @staticmethod
    def _name(n: int) -> str:
        return f"{n:012d}.json"

    def _write(self, name: str, doc: dict, overwrite: bool) -> None:
        out = self.files.fs.create(self.files.at(name), overwrite)
        out.write(bytearray(json.dumps(doc).encode()))
        out.close()

    def put(self, n: int, doc: dict) -> None:
        """Number n anew: written aside, then put in its place."""
        f = self.files
        self._write(f"_{self._name(n)}", doc, True)
        f.remove(self._name(n))
        f.fs.rename(f.at(f"_{self._name(n)}"), f.at(self._name(n)))
        if self.keep is not None:
            for old in [x for x in self.numbers() if x <= n - self.keep]:
                f.remove(self._name(old))

    def append(self, doc: dict) -> int:
        """The next number; two writers never share one."""
        n = max(self.numbers(), default=-1) + 1
        while True:
            try:
                self._write(self._name(n), doc, False)
                return n
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                n += 1

    def numbers(self) -> list[int]:
        return [int(x.split(".")[0]) for x in self.files.names() if x[0].isdigit()]

    def get(self, n: int) -> dict | None:
        f = self.files
        if not f.exists(self._name(n)):
            return None
        stream = f.fs.open(f.at(self._name(n)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def after(self, n: int) -> Iterator[tuple[int, dict]]:
        """Documents above n, up to the first that is not there."""
        while (doc := self.get(n + 1)) is not None:
            n += 1
            yield n, doc

    def newest(self, below: int | None = None) -> dict | None:
        have = [n for n in self.numbers() if below is None or n < below]
        return self.get(max(have)) if have else None


class SumStore:
    """Sums by key that grow by one part per batch: adding a batch again replaces its part, so nothing counts twice.

    Once ``parts`` wait, all but the newest are merged into a new base, which says up to which batch it goes; parts up
    to there are read no more, so a merge that is cut off, or done twice, changes no sum. A base is as large as the number of
    keys, whatever the number of batches.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, sums: Sequence[str], parts: int = PARTS):
        self.spark, self.folder, self.sums, self.parts = spark, folder, list(sums), parts
        self.schema = spark.createDataFrame([], schema).schema
        self.keys = [c for c in self.schema.names if c not in self.sums]
        self.files = Files(spark, folder)

    def _summed(self, df: DataFrame) -> DataFrame:
        total = df.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])
        return total.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])

    def _bases(self) -> list[int]:
        return sorted(int(x.split("=")[1]) for x in self.files.names("base") if self.files.exists("base", x, "_SUCCESS"))

    def _waiting(self) -> list[int]:
        return sorted(int(x.split("=")[1]) for x in self.files.names("parts"))

    def add(self, df: DataFrame, batch: int) -> None:
        upto = max(self._bases(), default=-1)
        if batch <= upto:
            return  # merged already: the batch was complete
        self._summed(df).write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch}")
        old = [b for b in self._waiting() if upto < b < batch]
        if len(old) >= self.parts:
            self.compact(max(old))

    def _union(self, upto: int | None = None) -> DataFrame:
        base = max(self._bases(), default=-1)
        paths = [f"{self.folder}/base/upto={base}"] if base >= 0 else []
        paths += [f"{self.folder}/parts/batch={b}" for b in self._waiting() if b > base and (upto is None or b <= upto)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def compact(self, upto: int) -> None:
        """Base and parts up to a batch become the new base."""
        before = self._bases()
        self._summed(self._union(upto)).write.mode("overwrite").parquet(f"{self.folder}/base/upto={upto}")
        for b in self._waiting():
            if b <= max(before, default=-1):
                self.files.remove("parts", f"batch={b}")  # what the base before this one holds; the newer ones may be being read
        for b in before[:-1]:
            self.files.remove("base", f"upto={b}")

    def read(self) -> DataFrame:
        return self._summed(self._union())
