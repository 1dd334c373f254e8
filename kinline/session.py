"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


# Fixed value: most bytes that go to a Python worker at a time. Kernels work on blocks of a MB; the default of 64 MB is held
# several times over, in the JVM and in each worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each context; they need no install of it. Batches of a session whose application doesn't say otherwise are small."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if getattr(sc, "_kinline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="kinline-"), "kinline_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._kinline_shipped = True


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is run within loses its shuffle files at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def scratch_base(spark: SparkSession) -> str:
    """A folder of this application in the shared folder that ``spark.checkpoint.dir`` names.

    Where that is unset a local session gets a temporary folder; on a cluster, whose executors wouldn't see it, that
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kinline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kinline-{spark.sparkContext.applicationId}"
