"""One place for the session settings that the engine expects."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "flaglens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC times and adaptive execution; the cluster's own settings win over none of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Bytes of a batch that goes to a Python worker, which holds it several times over; Spark's own 64 MB are kept only where asked for.
BATCH_BYTES, SPARKS_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
BATCH = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for a context, so that Python functions of it load there; and keep the batches
    that they get to BATCH bytes (a longer row is a batch of its own)."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_BYTES) and spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == SPARKS_BYTES:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    if not getattr(context, "_flaglens_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="flaglens-")) / "flaglens.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._flaglens_shipped = True
    return spark
