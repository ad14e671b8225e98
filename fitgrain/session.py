"""Session helpers: the shared scratch folder and settings held for one block."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without it a local session uses a folder under its warehouse. On a cluster the
    setting is required, because executors must all reach the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(f"{warehouse}/fitgrain-shared")
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clear_staged)
    _made.append((spark, path))
    return path


def clear_staged() -> None:
    """Remove what ``fresh_path`` named. It runs when Python ends while the session is
    still there; a session that is stopped before can call it first."""
    while _made:
        spark, path = _made.pop()
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def settings(spark: SparkSession, **values):
    """Hold session settings (``__`` stands for ``.``) for the length of a block."""
    names = {key.replace("__", "."): str(value) for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
