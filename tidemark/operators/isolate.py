"""Work on scenes of which some fail: one bad scene is a receipt, not a failed job.

A task works on its scenes one after another. A scene that raises is tried again, up to `tries` times and as long as the
task has retries left in its budget, so that a source that fails throughout doesn't hold a task up; then a row says why.
What the work gives is only taken once it is whole: a scene gives all of its rows or a receipt. Errors that aren't the
scene's - out of memory, an interrupt - fail the task, which Spark repeats elsewhere.

Defined results: a null key is a scene like others; a scene without rows gives none, and no receipt; an empty table an
empty one; the scene's columns go to the work as a dict, however they are named.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FATAL = (MemoryError, KeyboardInterrupt, SystemExit)


def isolated(scenes: DataFrame, key: str, work: Callable[[dict], Iterable[tuple]], schema: str, tries: int = 3, budget: int = 20, wait_s: float = 0.0) -> DataFrame:
    """_scene (the key), _tries, _reason, _detail and `schema`: the rows of work(scene), and one row for each scene that failed.

    Consumers of both should read a checkpoint of it: the work runs once.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made: StructType = _parse_datatype_string(schema)
    out = StructType().add("_scene", scenes.schema[key].dataType).add("_tries", "integer").add("_reason", "string").add("_detail", "string")
    for f in made:
        out = out.add(f.name, f.dataType, True)
    arrow, n = to_arrow_schema(out), len(made.fields)
    types = to_arrow_schema(made)

    def each(batches):
        left = budget
        for b in batches:
            rows: list[tuple] = []
            for scene in b.to_pylist():
                for attempt in range(1, tries + 1):
                    try:
                        got = [tuple(r) for r in work(scene)]
                        pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), types, strict=True)] if got else [pa.array([], f.type) for f in types], schema=types)  # values that don't fit are the scene's fault
                        rows += [(scene[key], attempt, None, None, *r) for r in got]
                        break
                    except FATAL:
                        raise
                    except Exception as e:  # noqa: BLE001  whatever a scene raises is told in its receipt
                        if attempt == tries or left == 0:
                            rows.append((scene[key], attempt, "failed" if left else "failed, no retries left", f"{type(e).__name__}: {e}"[:500], *[None] * n))
                            break
                        left -= 1
                        time.sleep(wait_s * attempt)
            cols = zip(*rows, strict=True) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return scenes.mapInArrow(each, out)


def results(done: DataFrame) -> DataFrame:
    return done.where("_reason is null").drop("_tries", "_reason", "_detail")


def receipts(done: DataFrame) -> DataFrame:
    """scene, reason, detail, tries of what failed."""
    return done.where("_reason is not null").select(F.col("_scene").alias("scene"), F.col("_reason").alias("reason"), F.col("_detail").alias("detail"), F.col("_tries").alias("tries"))
