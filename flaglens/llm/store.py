"""Tables that outlive an executor: written once to the folder that the cluster shares, then read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that may be broadcast: at 16 bytes of ids each this stays near 100 MB as a hashed relation.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='flaglens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """A folder of one run's intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/flaglens/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: dict[str, None] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df and read it back, so that nothing above it is computed again when an executor is lost."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        self._tables[path] = None
        return self.read(path, df)

    def read(self, path: str, like: DataFrame) -> DataFrame:
        out = self.spark.read.schema(like.schema).parquet(path)
        out._flaglens_path = path  # for drop()
        return out

    def alias(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """df, which reads the kept table and nothing else, as a name of it for drop()."""
        df._flaglens_path = table._flaglens_path
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for df in tables:
            self._delete(getattr(df, "_flaglens_path", None))

    def drop_all(self, *but: DataFrame) -> None:
        """Delete every kept table but those that the result still reads."""
        keep = {df._flaglens_path for df in but}
        for path in [p for p in self._tables if p not in keep]:
            self._delete(path)

    def _delete(self, path: str | None) -> None:
        if path:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            self._tables.pop(path, None)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that clashes with none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_ddl(df: DataFrame) -> str:
    """The columns of df as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
