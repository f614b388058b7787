"""Arrow helpers shared by the text operators.

``map_text`` hands whole texts to a function in slices of bounded bytes, so that a batch of
very long texts never becomes one large Python object. Columns are chosen by name before the
map, so extra or clashing columns of the input never reach an operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20


def fresh(taken: list[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes to be new (case is ignored)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of one text column; one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def map_text(
    df: DataFrame,
    fn: Callable[[list[str | None]], list],
    fields: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of ``df`` and new ``fields`` (DDL), which ``fn`` makes of whole texts.

    ``fn`` gets the texts of a slice and returns one sequence per field. The names of the new
    fields must not be among ``keep``.
    """
    added = StructType.fromDDL(fields)
    schema = StructType([df.schema[c] for c in keep] + added.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(added)]
    names = [f.name for f in schema]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(fresh(keep, "text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep)):
                made = fn(part.column(len(keep)).to_pylist())
                arrays = [
                    m if isinstance(m, pa.Array) else pa.array(m, kind)
                    for m, kind in zip(made, kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *arrays], names=names)

    return source.mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array out of flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, m: int):
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % m


def labelled_sample(labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most about ``rows`` rows of ``labels``, chosen by a hash of the key.

    The documented bound of the classifiers: in expectation ``rows`` rows, small enough to be
    broadcast to the documents. All rows are taken while there are no more than that.
    """
    total = labels.count()
    if total <= rows:
        return labels
    share = int(rows / total * 1_000_000)
    return labels.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000_000)) < share)
