"""The engine's front: files or claims in, profiles and projections out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.config import OutputConfig, default_config
from claimloom.operators import fuse, link
from claimloom.plans import project
from claimloom.sources.files import claims_of
from claimloom.storage import stored


def session(app: str = "claimloom", **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rest on."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def build_profiles(claims: DataFrame, compat: str = "default") -> DataFrame:
    """Claims -> one profile per entity, ordered only where it is written."""
    return fuse.fuse(claims, stored(link.link(claims, compat), "clusters"))


def profiles_of_files(spark: SparkSession, paths: list[str], compat: str = "default") -> DataFrame:
    return build_profiles(claims_of(spark, paths), compat)


def run(spark: SparkSession, paths: list[str], config: OutputConfig | None = None, mode: str = "strict") -> DataFrame:
    """Files -> the configured columns of every profile."""
    return project.project(profiles_of_files(spark, paths), config or default_config(), mode)
