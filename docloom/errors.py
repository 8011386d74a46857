"""Errors as exceptions (strict use on the driver) and as texts (columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the prefix of each area and of each kind of error
AREAS = {
    "config": "Configuration error: ",
    "provider": "Provider error: ",
    "workflow": "Workflow error: ",
    "repository": "Repository error: ",
    "io": "IO error: ",
    "docgen": "Documentation generation error: ",
}
KINDS = {
    "config.load": "Failed to load config: ",
    "config.validation": "Validation error: ",
    "provider.auth": "Authentication failed: ",
    "provider.api": "API error: ",
    "provider.network": "Network error: ",
    "provider.serialization": "Serialization error: ",
    "workflow.parse": "Plan parsing failed: ",
    "workflow.execution": "Execution failed: ",
    "repository.git": "Git operation failed: ",
    "repository.scan": "Scan failed: ",
    "docgen.template": "Template error: ",
    "docgen.generation": "Generation error: ",
    "docgen.io": "IO error: ",
}


class DocloomError(Exception):
    """An error with its kind, such as ``workflow.parse``."""

    def __init__(self, kind: str, message: str):
        self.kind, self.message = kind, message
        super().__init__(format_error(kind, message))


def format_error(kind: str, message: str) -> str:
    return AREAS[kind.split(".")[0]] + KINDS.get(kind, "") + message


def error_text(kind: Column, message: Column) -> Column:
    """The message behind the prefixes of its area and kind; null for an unknown area."""
    area = F.create_map(*[F.lit(x) for pair in AREAS.items() for x in pair])[F.substring_index(kind, ".", 1)]
    prefix = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[kind]
    return F.concat(area, F.coalesce(prefix, F.lit("")), message)


def error(kind: str, message: Column | str) -> Column:
    """A STRUCT<kind, message> column."""
    return F.struct(F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
