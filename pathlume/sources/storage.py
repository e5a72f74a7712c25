"""Finding the files of a dataset on any file system Spark can read (local paths, ``file://``, ``s3a://``, ``hdfs://`` ...)."""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession

DEFAULT_PATTERN = "*.parquet"


@dataclass(frozen=True)
class DataFiles:
    """Direct children of a folder that match a pattern, by name; with their bytes."""

    basepath: str
    names: tuple[str, ...]
    sizes: tuple[int, ...]

    @property
    def total_parts(self) -> int:
        return len(self.names)

    @property
    def total_bytes(self) -> int:
        return sum(self.sizes)

    def paths(self, names: list[str] | None = None) -> list[str]:
        return [f"{self.basepath}/{n}" for n in (self.names if names is None else names)]


def hadoop_path(path: str) -> str:
    """``s3://`` is read through the ``s3a`` file system; a path without a scheme is local."""
    if path.startswith("s3://"):
        return "s3a://" + path[5:]
    return path if "://" in path else f"file://{path}"


def discover_files(spark: SparkSession, basepath: str, pattern: str = DEFAULT_PATTERN) -> DataFiles:
    """Raises ``FileNotFoundError`` for a missing folder; no matching file gives an empty listing."""
    base = hadoop_path(basepath.rstrip("/"))
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        raise FileNotFoundError(basepath)
    found = sorted((s.getPath().getName(), s.getLen()) for s in files.listStatus(folder) if s.isFile() and fnmatchcase(s.getPath().getName(), pattern))
    return DataFiles(base, tuple(n for n, _ in found), tuple(size for _, size in found))


def read_parts(spark: SparkSession, files: DataFiles, names: list[str] | None = None) -> DataFrame:
    return spark.read.parquet(*files.paths(names))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under an explicit schema; rows that do not fit it are an error."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Parquet or CSV by the ending of ``path``."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("the path must end in .csv or .parquet")
