"""Exports of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.enrichment import Structured
from ..operators.records import csv_records, json_records, records
from ..operators.stix import bundle_objects
from ..session import written

FORMATS = frozenset(("json", "csv", "stix"))


def write_json(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_records(nested).write.mode(mode).partitionBy("ioc_type").json(path)


def write_csv(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    # Quotes are doubled, as other CSV readers expect.
    csv_records(nested).write.mode(mode).option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_stix(objects: DataFrame, path: str, mode: str = "overwrite") -> None:
    objects.select(F.col("json").alias("value")).write.mode(mode).text(path)


def export(batch: Structured, path: str, as_of: Column | str, formats=FORMATS) -> dict:
    """Write the chosen formats below ``path``; gives the rows written per format."""
    chosen = FORMATS & set(formats)
    counts = {}
    if chosen & {"json", "csv"}:
        nested = written(records(batch, as_of), "records")
        for name, write in (("json", write_json), ("csv", write_csv)):
            if name in chosen:
                write(nested, f"{path}/{name}")
                counts[name] = nested.count()
    if "stix" in chosen:
        objects = written(bundle_objects(batch, as_of), "stix")
        write_stix(objects, f"{path}/stix")
        counts["stix"] = objects.count()
    return counts
