"""The Python interface: registering datasets and running queries over them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from pathlume.plans.engine import CohortEngine
from pathlume.plans.errors import ProblemKind, QueryProblem
from pathlume.plans.validate import Checked, check
from pathlume.sources.catalog import Catalog, Dataset, RegistrationError
from pathlume.sources.storage import write_rows
from pathlume.stats import run_metrics

POLL_S = 0.25


def _request_id() -> str:
    return f"{int(time.time())}-{uuid.uuid4().hex[:8]}"


class Lume:
    """All operations over one catalog. Results are plain documents; failures of a request are results with ``success`` false."""

    def __init__(self, spark: SparkSession, catalog_root: str):
        self.spark, self.catalog = spark, Catalog(spark, catalog_root)

    # --- datasets

    def register_dataset(self, name: str, basepath: str, group_id_column: str, timestamp_column: str, **options) -> dict:
        begun, request = time.time(), _request_id()
        try:
            dataset = self.catalog.register(name, basepath, group_id_column, timestamp_column, **options)
        except (RegistrationError, FileNotFoundError) as e:
            return {"success": False, "errorMessage": str(e), "requestId": request}
        return {"success": True, "requestId": request, "dataset": {"name": name, "registeredAt": dataset.registered_at, "basepath": dataset.basepath, "totalParts": len(dataset.file_names)}, "stats": {"totalTime": time.time() - begun}}

    def list_datasets(self) -> list[dict]:
        return [{"name": d.name, "registeredAt": d.registered_at, "basepath": d.basepath, "totalParts": len(d.file_names), "groupIdColumn": d.group_id_column, "timestampColumn": d.timestamp_column} for d in self.catalog.list()]

    def get_dataset(self, name: str) -> Dataset | None:
        return self.catalog.get(name)

    def get_dataset_schema(self, name: str, full: bool = False) -> dict | None:
        dataset = self.catalog.get(name)
        return None if dataset is None else dataset.full_schema() if full else dataset.short_schema()

    def get_dataset_parts(self, name: str) -> dict | None:
        dataset = self.catalog.get(name)
        return None if dataset is None else dataset.parts()

    def unregister_dataset(self, name: str, force: bool = False) -> dict:
        return self.catalog.unregister(name, force)

    # --- queries

    def expand_and_validate_query(self, name: str | None, query: object, schema_only: bool = False) -> Checked:
        dataset = self.catalog.get(name) if name else None
        return check(query, dataset.context() if dataset else None, schema_only)

    def run_query(self, name: str, query: dict, request: str | None = None, export_metrics: str | None = None) -> dict:
        """The result document with statistics, or what is wrong with the request. ``export_metrics`` names a Parquet or CSV path for the run's
        figures in long form."""
        request, begun = request or _request_id(), time.time()
        try:
            dataset = self.catalog.get(name)
            if dataset is None:
                raise QueryProblem(ProblemKind.INVALID_ARGUMENTS, f"there is no dataset {name}")
            result = CohortEngine(dataset.group_id_column, dataset.timestamp_column).run(self.catalog.read(name), query, dataset.context())
        except QueryProblem as problem:
            return {"success": False, "requestId": request, "errorMessage": problem.message, "errorKind": problem.kind.name}
        self.catalog.mark_used(name)
        context = self.spark.sparkContext
        outer = context.getLocalProperty("spark.jobGroup.id")
        context.setJobGroup(request, f"query over {name}")
        try:
            found = result.to_dict()
            queried = time.time() - begun
            counts = result.scanned().first()
            done = self.progress(request)
        finally:
            context.setLocalProperty("spark.jobGroup.id", outer)
        seconds, scanned = {"query": queried, "total": time.time() - begun}, {"rows": counts["scanned_rows"], "groups": counts["scanned_groups"]}
        if export_metrics:
            write_rows(run_metrics(self.spark, request, seconds, scanned, done), export_metrics)
        stats = {
            "totalTime": seconds["total"],
            "queryTime": queried,
            "totalTasks": done["tasks"],
            "failedTasks": done["failed"],
            "scannedRows": scanned["rows"],
            "scannedGroups": scanned["groups"],
            "dataset": {"totalParts": len(dataset.file_names), "totalSize": sum(dataset.file_sizes)},
            "cost": None,
        }
        warnings = {"warnings": result.checked.warnings} if result.checked.warnings else {}
        return {"success": True, "requestId": request, **found, "stats": stats, **warnings}

    def run_query_async(self, name: str, query: dict) -> tuple[str, Future]:
        """The request id, which is also the job group of the query's Spark jobs, and the result to come."""
        request, done = _request_id(), Future()

        def work() -> None:
            self.spark.sparkContext.setJobGroup(request, f"query over {name}")
            try:
                done.set_result(self.run_query(name, query, request))
            except BaseException as e:  # noqa: BLE001
                done.set_exception(e)

        InheritableThread(target=work, daemon=True).start()
        return request, done

    def progress(self, request: str) -> dict:
        """Tasks of a running query by state."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(request) if (job := tracker.getJobInfo(j)) for s in job.stageIds]
        stages = [s for s in stages if s]
        return {"tasks": sum(s.numTasks for s in stages), "running": sum(s.numActiveTasks for s in stages), "finished": sum(s.numCompletedTasks for s in stages), "failed": sum(s.numFailedTasks for s in stages)}

    def stream_query(self, name: str, query: dict, every_s: float = POLL_S) -> Iterator[dict]:
        """Documents of the query's progress, then its result."""
        request, done = self.run_query_async(name, query)
        while not done.done():
            yield {"requestId": request, "stage": "RUNNING", "progress": self.progress(request)}
            time.sleep(every_s)
        yield done.result()
