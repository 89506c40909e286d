"""Settings with defaults; each may be set in the session under ``paperloom.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    # fixed values: the defaults that users rely on
    port: int = 3000
    graph_uri: str = "bolt://localhost:7687"
    graph_user: str = "neo4j"
    store_endpoint: str = "localhost"
    store_port: int = 9000
    store_ssl: bool = False
    store_bucket: str = "papers"
    # engine parameters
    feed_page: int = 100
    list_size: int = 50
    graph_rows: int = 200
    embedding_dimension: int = 768
    embedding_chars: int = 2000
    model_chars: int = 60000
    rate_limit: int = 100
    rate_seconds: int = 60
    poll_seconds: int = 3600
    fetch_attempts: int = 3
    fetch_wait: int = 5
    fetch_seconds: int = 30
    fetch_in_flight: int = 4
    categories: str = "cs.LG,cs.AI"

    @property
    def store_address(self) -> str:
        return f"{self.store_endpoint}:{self.store_port}"

    @property
    def store_url(self) -> str:
        return f"{'https' if self.store_ssl else 'http'}://{self.store_address}"


def _int_prefix(value: str, default: int) -> int:
    """A leading integer, as lenient parsers read it; the default without one."""
    digits = value.strip()
    sign = digits[:1] if digits[:1] in "+-" else ""
    n = 0
    while n < len(digits) - len(sign) and digits[len(sign) + n].isdigit():
        n += 1
    return int(sign + digits[len(sign) : len(sign) + n]) if n else default


def config(spark: SparkSession) -> Config:
    found = {}
    for f in fields(Config):
        value = spark.conf.get(f"paperloom.{f.name}", None)
        if value is not None:
            found[f.name] = value == "true" if isinstance(f.default, bool) else _int_prefix(value, f.default) if isinstance(f.default, int) else value
    return Config(**found)
