"""What can be wrong with a query."""

from __future__ import annotations

from enum import Enum


class ProblemKind(Enum):
    SCHEMA = "schema"
    RELATION = "relation"
    DATASET_MISMATCH = "dataset_mismatch"
    TYPE_MISMATCH = "type_mismatch"
    INVALID_ARGUMENTS = "invalid_arguments"
    UNEXPECTED = "unexpected"


class QueryProblem(ValueError):
    def __init__(self, kind: ProblemKind, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message


def schema_problem(where: str, what: str) -> QueryProblem:
    return QueryProblem(ProblemKind.SCHEMA, f"{where}: {what}")
