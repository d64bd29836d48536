"""Published results: parts that are never changed, and a manifest exchanged last.

A run writes its months as a part of its own and its documents as a release of its
own. Then one file is added to the manifest: the new version, which says for each
table and month which part holds it, and which release is current. Readers go by
the newest version alone. A run that ends before that file is in place has changed
nothing that can be read, and no month is ever deleted to be written again.

The manifest has a row for each table and month. One run publishes at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, release string, name string, month string, part string"


class Published:
    """Month tables and documents of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version, self.release, self.parts = 0, None, {}
        newest = self._newest()
        for row in newest:
            self.version, self.release = row["version"], row["release"]
            if row["name"] is not None:
                self.parts[row["name"], row["month"]] = row["part"]

    def _newest(self) -> list:
        """Rows of the newest version; none where nothing was ever published. A
        manifest that cannot be read is an error, not an empty one."""
        try:
            rows = self.spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(
                f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last = rows.agg(F.max("version").alias("version"))
        return rows.join(last, "version").collect()

    def path(self, document: str) -> str:
        """Where a document of the current release lies."""
        if self.release is None:
            raise FileNotFoundError(f"nothing is published in {self.folder}")
        return f"{self.folder}/{self.release}/{document}"

    def table(self, name: str, schema: T.StructType, month: str) -> DataFrame:
        """All months of a table, each from the part that holds it."""
        wanted: dict[str, list[str]] = {}
        for (table, label), part in self.parts.items():
            if table == name:
                wanted.setdefault(part, []).append(label)
        whole = self.spark.createDataFrame([], schema)
        for part, labels in sorted(wanted.items()):
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{part}/{name}")
            whole = whole.unionByName(rows.where(F.col(month).cast("string").isin(labels)))
        return whole

    def draft(self) -> Draft:
        return Draft(self)


class Draft:
    """The next version, seen by nobody until it is committed."""

    def __init__(self, base: Published):
        self.base, self.tag = base, uuid.uuid4().hex
        self.view = Published.__new__(Published)
        self.view.__dict__.update(base.__dict__, parts=dict(base.parts),
                                  version=base.version + 1, release=f"release-{self.tag}")

    def put(self, name: str, rows: DataFrame, months: DataFrame, month: str,
            replace: bool = False) -> DataFrame:
        """Hold ``months`` of a table as in ``rows``, a month without rows as empty.

        ``replace`` drops all other months. Returns the table as it will be.
        """
        part = f"part-{self.tag}"
        label = F.col(month).cast("string")
        covered = [r[0] for r in months.select(label).distinct().collect()]  # a row a month
        rows.write.partitionBy(month).parquet(f"{self.base.folder}/{part}/{name}")
        held = [r[0] for r in self.base.spark.read.schema(rows.schema).parquet(
            f"{self.base.folder}/{part}/{name}").select(label).distinct().collect()]
        self.view.parts = {k: v for k, v in self.view.parts.items()
                           if k[0] != name or not (replace or k[1] in covered)}
        self.view.parts |= {(name, m): part for m in held if m in covered}
        return self.view.table(name, rows.schema, month).select(*rows.columns)

    def path(self, document: str) -> str:
        return self.view.path(document)

    def commit(self) -> None:
        """Exchange the manifest: one file, put in place whole."""
        head = (self.view.version, self.view.release)
        rows = [(*head, *k, part) for k, part in sorted(self.view.parts.items())]
        (self.base.spark.createDataFrame(rows or [(*head, None, None, None)], MANIFEST)
         .coalesce(1).write.mode("append").json(f"{self.base.folder}/manifest"))
