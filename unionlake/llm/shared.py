"""Files that workers write and read in the shared folder of the session."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

from unionlake.session import scratch_path


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.  Workers open its files themselves, so it must be mounted on all of them."""
    path = f"{scratch_path(spark, name)}-{uuid.uuid4().hex}"
    if re.match(r"[a-z0-9]+:", path):
        raise ValueError(f"binary files need a shared folder that is mounted on all machines, not {path}")
    return path


class Atomic:
    """A file that appears under its name only when it is complete, so a task that is lost or runs twice leaves no part of it."""

    def __init__(self, path: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.path, self.temp = path, f"{path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.file = open(self.temp, "wb")
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        os.replace(self.temp, self.path) if kind is None else os.unlink(self.temp)
