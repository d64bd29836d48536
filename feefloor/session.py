"""Session settings, the shared work folder, and the group-size split.

Nothing here collects table rows; the driver only ever learns one boolean
(``isEmpty``) or a row count.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "feefloor", master: str | None = None,
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A private temporary folder stands in only when the setting is absent and
    the session is a single local JVM.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/feefloor/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="feefloor-")
    return _local_dirs[app]


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives executor loss and, unlike a checkpointed RDD,
    keeps column pruning and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WorkTables:
    """Written tables of one call, removed when the call is over.

    ``cut`` is ``cut_lineage``; a table passed to ``keep`` outlives the call.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[str, DataFrame]] = {}

    def __enter__(self) -> WorkTables:
        return self

    def __exit__(self, *_failure) -> None:
        for path, _df in self._paths.values():
            remove_folder(self.spark, path)

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (path, table)
        return table

    def keep(self, table: DataFrame) -> DataFrame:
        del self._paths[id(table)]
        return table


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def split_by_group_size(df: DataFrame, key: str, limit: int
                        ) -> tuple[DataFrame, DataFrame | None]:
    """Split into rows of groups of at most ``limit`` rows, and all others.

    The second part is None when no group is over the limit, which is the
    normal case for blocks of a chain with a consensus size cap. The list of
    oversized keys holds at most rows/limit entries.
    """
    large = df.groupBy(key).count().where(f"count > {limit}").select(key)
    large = cut_lineage(large, "large-groups")
    if large.isEmpty():
        return df, None
    return df.join(large, key, "left_anti"), df.join(large, key, "left_semi")
