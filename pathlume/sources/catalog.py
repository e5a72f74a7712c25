"""Registered datasets: names for sets of Parquet files with checked key columns, a schema and column statistics.

Every dataset is one JSON document in the catalog's folder, replaced as a whole when it is registered again.
"""

from __future__ import annotations

import json
import random
import re
import time
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.functions.normalize import col, without_nan
from pathlume.operators.table_profile import column_kinds, groups_in_many_parts, numeric_ranges, text_profile, top_values, value_counts
from pathlume.plans.validate import QueryContext, logical_type
from pathlume.sources.storage import DEFAULT_PATTERN, DataFiles, discover_files, hadoop_path, read_parts
from pathlume.sources.workspace import read_text, remove_path, replace_text

SAMPLE_SHARE, SAMPLE_MOST = 0.1, 10
UNREGISTER_AFTER_S = 30
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.\-]*")


class ValidationMode(Enum):
    SINGLE = "single"
    FIRST_LAST = "first_last"
    SAMPLE = "sample"
    ALL = "all"


class RegistrationError(ValueError):
    pass


@dataclass
class Dataset:
    name: str
    registered_at: float
    basepath: str
    pattern: str
    group_id_column: str
    timestamp_column: str
    file_names: list[str]
    file_sizes: list[int]
    columns: dict[str, str]
    unsupported: dict[str, str]
    min_timestamp: float | None
    max_timestamp: float | None
    numeric: dict[str, list[float | None]] = field(default_factory=dict)
    text: dict[str, dict] = field(default_factory=dict)

    @property
    def identity(self) -> tuple[str, float]:
        """Name and version."""
        return self.name, self.registered_at

    def parts(self) -> dict:
        return {"totalParts": len(self.file_names), "totalBytes": sum(self.file_sizes), "namingMethod": "LIST", "filenames": self.file_names}

    def short_schema(self) -> dict:
        """Names and types, the span of times, and top values of categorical columns."""
        return {
            "columns": self.columns,
            "minTimestamp": self.min_timestamp,
            "maxTimestamp": self.max_timestamp,
            "sourceCategoricals": [],
            "potentialCategoricals": sorted(c for c, p in self.text.items() if p["categorical"]),
        }

    def full_schema(self) -> dict:
        details = {}
        for name, kind in self.columns.items():
            low, high = self.numeric.get(name, (None, None))
            text = self.text.get(name, {})
            details[name] = {"coltype": kind, "numericMin": low, "numericMax": high, "categorical": text.get("categorical", False), "catUniqueRatio": text.get("ratio"), "catTopValues": text.get("top")}
        return {"groupIdColumn": self.group_id_column, "timestampColumn": self.timestamp_column, "columns": details, "unsupportedColumns": self.unsupported, "minTimestamp": self.min_timestamp, "maxTimestamp": self.max_timestamp}

    def context(self) -> QueryContext:
        return QueryContext(self.columns, self.group_id_column, self.timestamp_column, self.min_timestamp, self.max_timestamp)


def files_to_check(names: list[str], mode: ValidationMode, rng: random.Random) -> list[str]:
    """Which files are looked into: the first, first and last, or those and a sample (a tenth, at most ten) without repetition."""
    if not names:
        return []
    if mode is ValidationMode.ALL:
        return list(names)
    if mode is ValidationMode.SINGLE or len(names) == 1:
        return [names[0]]
    ends = [names[0], names[-1]]
    if mode is ValidationMode.FIRST_LAST or len(names) == 2:
        return ends
    extra = min(int(len(names) * SAMPLE_SHARE), SAMPLE_MOST)
    return [*ends, *rng.sample(names[1:-1], min(extra, len(names) - 2))]


def check_keys(df: DataFrame, group: str, time_column: str) -> None:
    """Group ids must be whole numbers or text without nulls; times numbers (or timestamps) without nulls and NaN."""
    for c in (group, time_column):
        if c not in df.columns:
            raise RegistrationError(f"there is no column {c}")
    if logical_type(df.schema[group].dataType) not in ("INT", "STRING"):
        raise RegistrationError(f"group id column {group} must hold whole numbers or text")
    stamped = df.schema[time_column].dataType.typeName().startswith("timestamp")
    if not stamped and logical_type(df.schema[time_column].dataType) not in ("INT", "FLOAT"):
        raise RegistrationError(f"time column {time_column} must hold numbers or timestamps")
    found = df.agg(F.count_if(col(group).isNull()).alias("g"), F.count_if(without_nan(col(time_column), df.schema[time_column].dataType).isNull()).alias("t")).first()
    if found["g"]:
        raise RegistrationError(f"group id column {group} has {found['g']} null values")
    if found["t"]:
        raise RegistrationError(f"time column {time_column} has {found['t']} null or NaN values")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, hadoop_path(root.rstrip("/"))

    def _path(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise RegistrationError(f"{name!r} is no name for a dataset")
        return f"{self.root}/{name}.json"

    def register(
        self,
        name: str,
        basepath: str,
        group_id_column: str,
        timestamp_column: str,
        pattern: str = DEFAULT_PATTERN,
        mode: ValidationMode = ValidationMode.SAMPLE,
        validate_uniques: bool = True,
        seed: int = 0,
    ) -> Dataset:
        """Check the files and record the dataset, replacing one of the same name."""
        path = self._path(name)
        files: DataFiles = discover_files(self.spark, basepath, pattern)
        if not files.names:
            raise RegistrationError(f"no files match {pattern} in {basepath}")
        chosen = files_to_check(list(files.names), mode, random.Random(seed))
        kinds = [column_kinds(read_parts(self.spark, files, [n])) for n in chosen]
        for n, k in zip(chosen, kinds):
            if k != kinds[0]:
                raise RegistrationError(f"columns of {n} are not those of {chosen[0]}")
        df = read_parts(self.spark, files, chosen)
        check_keys(df, group_id_column, timestamp_column)
        if validate_uniques and len(chosen) > 1:
            shared = groups_in_many_parts(df.select(col(group_id_column), F.col("_metadata.file_path").alias("__file")), group_id_column, "__file")
            if shared.limit(1).count():
                raise RegistrationError(f"groups of {group_id_column} occur in more than one file")
        columns, unsupported = kinds[0]
        dataset = Dataset(name, time.time(), files.basepath, pattern, group_id_column, timestamp_column, list(files.names), list(files.sizes), columns, unsupported, None, None)
        self._profile(df, dataset)
        replace_text(self.spark, path, json.dumps(asdict(dataset)))
        if read_text(self.spark, f"{path}.used") is not None:
            remove_path(self.spark, f"{path}.used")
        return dataset

    def _profile(self, df: DataFrame, dataset: Dataset) -> None:
        known = df.select(*(col(c) for c in dataset.columns))
        dataset.numeric = {r["column_name"]: [r["numeric_min"], r["numeric_max"]] for r in numeric_ranges(known).collect()}
        dataset.min_timestamp, dataset.max_timestamp = dataset.numeric.get(dataset.timestamp_column, (None, None))
        counts = value_counts(known)
        dataset.text = {r["column_name"]: {"categorical": r["categorical"], "ratio": r["cat_unique_ratio"], "top": {}} for r in text_profile(counts).collect()}
        for r in top_values(counts).orderBy(F.col("share").desc(), "value").collect():
            if dataset.text[r["column_name"]]["categorical"]:
                dataset.text[r["column_name"]]["top"][r["value"]] = r["share"]

    def get(self, name: str) -> Dataset | None:
        text = read_text(self.spark, self._path(name))
        return Dataset(**json.loads(text)) if text else None

    def list(self) -> list[Dataset]:
        """All datasets, the latest registered first."""
        try:
            names = discover_files(self.spark, self.root, "*.json").names
        except FileNotFoundError:
            return []
        return sorted((d for n in names if (d := self.get(n.removesuffix(".json")))), key=lambda d: (-d.registered_at, d.name))

    def mark_used(self, name: str) -> None:
        replace_text(self.spark, f"{self._path(name)}.used", str(time.time()))

    def last_used(self, name: str) -> float | None:
        text = read_text(self.spark, f"{self._path(name)}.used")
        return float(text) if text else None

    def unregister(self, name: str, force: bool = False) -> dict:
        """Forget a dataset; its files stay. Refused within half a minute of its last query unless forced. A name not found is no error."""
        path, last = self._path(name), self.last_used(name)
        if self.get(name) is None:
            return {"success": True, "datasetFound": False, "datasetLastUsed": last}
        if not force and last is not None and time.time() - last < UNREGISTER_AFTER_S:
            return {"success": False, "errorMessage": "the dataset was used just now", "datasetFound": True, "datasetLastUsed": last}
        for gone in (path, f"{path}.used"):
            remove_path(self.spark, gone)
        return {"success": True, "datasetFound": True, "datasetLastUsed": last}

    def read(self, name: str) -> DataFrame:
        dataset = self.get(name)
        if dataset is None:
            raise RegistrationError(f"there is no dataset {name}")
        files = DataFiles(dataset.basepath, tuple(dataset.file_names), tuple(dataset.file_sizes))
        return read_parts(self.spark, files)


__all__ = ["Catalog", "Dataset", "RegistrationError", "ValidationMode"]
