"""Documents as rows of paths and values, so that two of them can be compared in any size and number."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: Rows that a task hands on at once.
ROWS_AT_ONCE = 10_000


def leaves(documents: DataFrame) -> DataFrame:
    """(name, path, value) of documents (name, value), a JSON text each: one row for each value that isn't a list or an object, and for each empty one.

    Paths are written as in JSON pointers, a value as JSON. A text that isn't JSON is one row with the path null and the text.
    """
    kind, at_once = documents.schema["name"], ROWS_AT_ONCE
    shape = StructType([kind, StructField("path", StringType()), StructField("value", StringType())])
    name_type = to_arrow_schema(shape).field("name").type

    def flat(text):
        import json

        try:
            open_ = [("", json.loads(text))]
        except ValueError:
            yield None, text
            return
        while open_:
            path, v = open_.pop()
            if isinstance(v, dict) and v:
                open_ += [(path + "/" + k.replace("~", "~0").replace("/", "~1"), x) for k, x in v.items()]
            elif isinstance(v, list) and v:
                open_ += [(f"{path}/{k}", x) for k, x in enumerate(v)]
            else:
                yield path, json.dumps(v, ensure_ascii=False)

    def run(batches):
        rows = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, value in flat(text or ""):
                    rows.append((name, path, value))
                    if len(rows) == at_once:
                        yield packed(rows)
                        rows = []
        yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((name_type, pa.string(), pa.string()))], names=["name", "path", "value"])

    return documents.select("name", "value").mapInArrow(run, shape)


def differences(now: DataFrame, golden: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(name, path, golden, now): what of documents (name, value) isn't as in the golden ones; null on the side that lacks it. Paths that begin like an ignored one don't count."""
    a, b = (leaves(d).withColumn("path", F.coalesce("path", F.lit("(no JSON)"))) for d in (golden, now))
    both = a.withColumnRenamed("value", "golden").join(b.withColumnRenamed("value", "now"), ["name", "path"], "full")
    out = both.where(~F.col("golden").eqNullSafe(F.col("now")))
    for prefix in ignored:
        out = out.where(~((F.col("path") == prefix) | F.col("path").startswith(f"{prefix}/")))
    return out
