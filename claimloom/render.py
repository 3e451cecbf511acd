"""Profiles as JSON text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.config import OutputConfig
from claimloom.plans import project


def checked(profiles: DataFrame, config: OutputConfig) -> DataFrame:
    """Profiles, failing on the first one that the configuration forbids."""
    said = [e for f in project.compile_config(config) for e in f.errors]
    if not said:
        return profiles
    first = F.coalesce(*said)
    return profiles.where(F.when(first.isNotNull(), F.raise_error(first).cast("boolean")).otherwise(True))


def render_json(profiles: DataFrame, config: OutputConfig) -> str:
    """One object, or an array of them in order of candidate_id; indented, keys in the configuration's order.

    The whole text is gathered on the driver; for large results write :func:`write_ndjson`.
    """
    rows = project.to_json(checked(profiles, config), config).orderBy("candidate_id", "json").toLocalIterator()
    objects = [json.loads(r["json"]) for r in rows]
    return json.dumps(objects[0] if len(objects) == 1 else objects, indent=2, ensure_ascii=False) + "\n"


def ndjson(profiles: DataFrame, config: OutputConfig) -> DataFrame:
    """(candidate_id, json): a line per profile with keys sorted at every level."""
    return project.to_json(checked(profiles, config), config, sort_keys=True)


def render_ndjson(profiles: DataFrame, config: OutputConfig) -> str:
    rows = ndjson(profiles, config).orderBy("candidate_id", "json").toLocalIterator()
    return "".join(project.python_json(r["json"]) + "\n" for r in rows)


def write_lines(profiles: DataFrame, config: OutputConfig, path: str) -> None:
    """The same text as one file of the driver, written line by line: the driver holds one partition at a time."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        for r in ndjson(profiles, config).orderBy("candidate_id", "json").toLocalIterator():
            out.write(project.python_json(r["json"]) + "\n")


def write_ndjson(profiles: DataFrame, config: OutputConfig, path: str) -> None:
    """Lines in order of candidate_id as files of one folder, written by the executors."""
    ndjson(profiles, config).orderBy("candidate_id", "json").select("json").write.text(path)


def write_text(text: str, path: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
