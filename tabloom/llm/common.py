"""What several operators share: tables cut from their lineage and word splitting."""

import tempfile
import uuid

#: White space of a word boundary: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def shared_path(spark, purpose):
    """A fresh path below spark.checkpoint.dir, which all executors share.

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tabloom-llm-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(frame, purpose):
    """The frame written once and read back: lost executors recompute nothing before it."""
    spark = frame.sparkSession
    path = shared_path(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(spark, *frames):
    """Delete tables that `stored` wrote and nothing reads any more."""
    for frame in frames:
        for path in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches, rows=512):
    """Arrow batches in parts of so many rows: a worker turns only these into Python values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What this worker keeps from task to task, for the one operator it last worked for.
_KEPT = {}


def kept(operator, make=tuple):
    """What `make` gives, kept until the worker turns to another operator; workers outlive stages, and so would all they remember."""
    if operator not in _KEPT:
        _KEPT.clear()
        _KEPT[operator] = make()
    return _KEPT[operator]


def unused(frame, name):
    """A column name that the frame does not have, whatever the case of letters."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text):
    """The words of a text as bytes, A-Z in lower case (bytes know no other letters)."""
    return text.encode().lower().split() if text else []
