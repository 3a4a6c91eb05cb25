"""A shared place for intermediate tables."""

import tempfile
import uuid

from tabloom.errors import TableError


def scratch_directory(spark, purpose):
    """A fresh path below the session's checkpoint directory.

    Only a local session without one, as in tests, falls back to a temporary folder: on
    a cluster that folder would exist on one machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise TableError("SCRATCH", "Set spark.checkpoint.dir to a shared folder.")
        base = tempfile.mkdtemp(prefix="tabloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept(frame, purpose):
    """A small table written once and read back.

    Unlike a cached one it cannot be taken for the table of another file that later has the same path.
    """
    path = scratch_directory(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
