"""Settings of an analysis, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

PREFIX = "spark.lintora."


@dataclass(frozen=True)
class Settings:
    # The defaults.
    enabled: bool = True
    debounce_ms: int = 400
    backend_url: str = "http://localhost:3000"
    developer_id: str = "DEV001"
    enable_ai: bool = False
    ife_url: str = "http://localhost:4000"
    min_confidence: float = 0.7

    def __post_init__(self):
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence lies between 0 and 1")
        if self.debounce_ms < 0:
            raise ValueError("debounce_ms is not negative")

    @property
    def debounce(self) -> str:
        return f"{self.debounce_ms} milliseconds"


def from_session(spark: SparkSession) -> Settings:
    """Settings of the session: spark.lintora.<name>, else the default."""
    said = {}
    for field in fields(Settings):
        value = spark.conf.get(PREFIX + field.name, None)
        if value is not None:
            kind = type(field.default)
            said[field.name] = value.lower() == "true" if kind is bool else kind(value)
    return Settings(**said)


def as_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """name, value (as text) of every setting."""
    rows = [(f.name, str(getattr(settings, f.name)).lower() if isinstance(f.default, bool) else str(getattr(settings, f.name))) for f in fields(settings)]
    return spark.createDataFrame(rows, "name string, value string")
