"""Sessions of activity separated by pauses, kept as an incremental table.

Rows of a group are first folded into cells as wide as the pause: two rows of one cell are never further apart than the pause, so
they belong to one session. The fold is a hash aggregation with map-side combination; afterwards a group holds at most (time span /
pause) rows however many it had before, and no task sees more than that for one group. Neighbouring cells are then joined into local
sessions, and local sessions of a new batch are joined with the stored ones that lie within the pause.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathlume.sources.workspace import create_text, names_in, read_text, remove_path, scratch_path

DEFAULT_PAUSE_MS = 1_800_000
SESSION_COLUMNS = ["dataset_name", "group_id", "start_ms", "end_ms", "n_events"]
SESSION_SCHEMA = T.StructType([T.StructField("dataset_name", T.StringType()), T.StructField("group_id", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("n_events", T.LongType())])


def merge_spans(spans: DataFrame, keys: list[str], pause_ms: int = DEFAULT_PAUSE_MS) -> DataFrame:
    """Join spans ``start_ms, end_ms, n_events`` of a key that overlap or are at most ``pause_ms`` apart."""
    by_time = W.partitionBy(*keys).orderBy("start_ms", "end_ms")
    before = by_time.rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("end_ms").over(before)
    opens = (reach.isNull() | (F.col("start_ms") - reach > F.lit(pause_ms))).cast("int")
    return (
        spans.withColumn("__opens", opens)
        .withColumn("__nth", F.sum("__opens").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "__nth")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_events").alias("n_events"))
        .drop("__nth")
    )


def local_sessions(rows: DataFrame, dataset_name: str, group_id: Column, time_ms: Column, pause_ms: int = DEFAULT_PAUSE_MS) -> DataFrame:
    """Sessions of one batch: ``dataset_name, group_id, start_ms, end_ms, n_events``.

    Rows with a null group id, or a time that is null or below 1, belong to no session. A pause of more than ``pause_ms`` starts a
    new session, one of exactly ``pause_ms`` does not. Repeated rows count as events but move no bound; a session of one row starts
    and ends with it. An empty table gives no rows; other columns are not read.
    """
    if pause_ms < 1:
        raise ValueError("pause_ms must be at least 1")
    cells = (
        rows.select(F.lit(dataset_name).alias("dataset_name"), group_id.cast("string").alias("group_id"), time_ms.alias("__t"))
        .filter(F.col("group_id").isNotNull() & (F.col("__t") >= 1))
        .groupBy("dataset_name", "group_id", F.floor(F.col("__t") / F.lit(pause_ms)).alias("__cell"))
        .agg(F.min("__t").alias("start_ms"), F.max("__t").alias("end_ms"), F.count(F.lit(1)).alias("n_events"))
        .drop("__cell")
    )
    return merge_spans(cells, ["dataset_name", "group_id"], pause_ms)


class SessionTable:
    """Sessions kept in shared storage, brought up to date batch by batch.

    The table is cut into slices of ``slice_ms`` by the start of the session, one folder each. Every version has a manifest, which names
    the folder of each slice with its earliest start and latest end. A batch (1) finds the slices whose sessions can lie within the
    pause of a session of the batch, (2) joins their sessions with those of the batch, bridged ones becoming one, (3) writes these slices
    anew and (4) creates the manifest of the next version. Other slices are neither read nor written.

    Readers see the table before the batch or after it. The folders of the last ``keep_versions`` versions stay, so a DataFrame that was
    taken from ``read`` can be evaluated until so many more batches came. Of two writers of the same version one creates the manifest;
    the other takes its batch to the version that then is. A batch that failed leaves no trace but unnamed folders.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, pause_ms: int = DEFAULT_PAUSE_MS, slice_ms: int = 7 * 86_400_000, keep_versions: int = 10):
        if pause_ms < 1 or slice_ms < 1 or keep_versions < 1:
            raise ValueError("pause_ms, slice_ms and keep_versions must be at least 1")
        self.spark, self.pause_ms, self.slice_ms, self.keep_versions = spark, pause_ms, slice_ms, keep_versions
        self.root = (root or scratch_path(spark, "sessions")).rstrip("/")
        manifest = self._manifest()
        if (manifest["pause_ms"], manifest["slice_ms"]) != (pause_ms, slice_ms):
            raise ValueError("the stored table has another pause or width of slices")

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        """Versions that are kept, oldest first."""
        return [int(name[:-5]) for name in names_in(self.spark, f"{self.root}/manifests") if name.endswith(".json") and name[:-5].isdigit()]

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "pause_ms": self.pause_ms, "slice_ms": self.slice_ms, "slices": {}, "batches": {}}
        return json.loads(read_text(self.spark, self._manifest_path(known[-1] if version is None else version)))

    def _slice(self) -> Column:
        return F.floor(F.col("start_ms") / F.lit(self.slice_ms)).cast("bigint")

    def _extent(self, sessions: DataFrame) -> list[tuple[int, int, int]]:
        """(slice, earliest start, latest end) of each slice: as many rows as the time span has slices."""
        return [tuple(r) for r in sessions.groupBy(self._slice().alias("slice")).agg(F.min("start_ms"), F.max("end_ms")).collect()]

    def _stored(self, slices: dict[str, dict]) -> DataFrame:
        folders = [s["folder"] for s in slices.values()]
        return self.spark.read.schema(SESSION_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SESSION_SCHEMA)

    def read(self, version: int | None = None) -> DataFrame:
        """The current sessions, or those of a version that is kept; no rows before the first batch."""
        return self._stored(self._manifest(version)["slices"])

    def apply(self, batch: DataFrame, source: str | None = None, number: int | None = None) -> bool:
        """Take in the local sessions of a batch (``local_sessions``). A batch without rows changes no row.

        With ``source`` and ``number`` the batch is taken once: numbers of a source rise, and one that is not above the last one taken is
        passed over (false). The number is kept in the manifest that names the batch's rows, so both are there or neither.
        """
        manifest = self._manifest()
        staged = None
        try:
            while True:
                if source is not None and number is not None and number <= manifest["batches"].get(source, -1):
                    return False
                if manifest["slices"] and staged is None:
                    staged = scratch_path(self.spark, "batch")
                    batch.select(*SESSION_COLUMNS).write.parquet(staged)
                path, slices = self._merged(manifest["slices"], batch if staged is None else self.spark.read.schema(SESSION_SCHEMA).parquet(staged))
                taken = {**manifest["batches"], **({source: number} if source is not None and number is not None else {})}
                after = manifest | {"version": manifest["version"] + 1, "slices": slices, "batches": taken}
                if create_text(self.spark, self._manifest_path(after["version"]), json.dumps(after)):
                    break
                remove_path(self.spark, path)  # another writer was first
                manifest = self._manifest()
        finally:
            if staged:
                remove_path(self.spark, staged)
        self.vacuum()
        return True

    def _merged(self, stored: dict[str, dict], batch: DataFrame) -> tuple[str, dict[str, dict]]:
        """The folder written and the slices of the table with the batch."""
        merged, touched = batch.select(*SESSION_COLUMNS), {}
        if stored:
            extent = self._extent(merged)
            new_slices = {str(s) for s, _, _ in extent}
            touched = {
                k: v
                for k, v in stored.items()
                if k in new_slices or any(lo - self.pause_ms <= v["max_end"] and v["min_start"] <= hi + self.pause_ms for _, lo, hi in extent)
            }
            merged = merge_spans(self._stored(touched).unionByName(merged), ["dataset_name", "group_id"], self.pause_ms)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        merged.select(*SESSION_COLUMNS, self._slice().alias("slice")).write.partitionBy("slice").parquet(path)
        written = self.spark.read.schema(T.StructType([*SESSION_SCHEMA.fields, T.StructField("slice", T.LongType())])).parquet(path)
        fresh = {str(s): {"folder": f"{path}/slice={s}", "min_start": lo, "max_end": hi} for s, lo, hi in self._extent(written)}
        return path, {**{k: v for k, v in stored.items() if k not in touched}, **fresh}

    def vacuum(self, keep_versions: int | None = None) -> None:
        """Remove the manifests before the last ``keep_versions`` and the folders that only they name."""
        known = self.versions()
        old = known[: -(keep_versions or self.keep_versions)]
        if not old:
            return
        folders = lambda versions: {s["folder"] for v in versions for s in self._manifest(v)["slices"].values()}
        for folder in folders(old) - folders(known[len(old) :]):
            remove_path(self.spark, folder)
        for version in old:
            remove_path(self.spark, self._manifest_path(version))
