"""Session set-up. Parallelism is Spark's own: master, shuffle partitions and adaptive execution."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Settings:
    """Thread settings of a local session; on a cluster the master decides."""

    share: float = 0.6
    threads: int | None = None

    def resolve(self, n_jobs: int = 0) -> int:
        """0: the set number or a share of all cores, at least one; -1: all cores; otherwise as given."""
        cores = os.cpu_count() or 1
        if n_jobs == -1:
            return cores
        return n_jobs if n_jobs > 0 else self.threads or max(1, int(cores * self.share))

    def as_dict(self) -> dict:
        return {"share": self.share, "threads": self.threads, "resolved": self.resolve()}

    def reset(self) -> None:
        self.share, self.threads = 0.6, None


def session(name: str = "millrace", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
