"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts are handed to the kernels in groups of about so many bytes, so that memory does not follow the batch size.
GROUP_BYTES = 2 << 20
#: Rows and bytes of texts that Spark sends to a Python worker at once; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of one row at least and of about ``max_bytes`` in ``column``."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, to be sent to Python in batches of BATCH_ROWS rows and BATCH_BYTES bytes at most.

    Sessions of ``session.build_session`` have both settings; in any other session a larger bound is lowered here, and
    stays so, since Spark reads it when the plan runs. Whole texts of ten thousand rows, Spark's default, would take up
    to hundreds of megabytes in each worker and as much again in its executor.
    """
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", conf.get(f"spark.sql.execution.arrow.{name}").lower()).groups()
        now = int(number) << 10 * " kmg".index(unit or " ")
        if now <= 0 or now > most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return docs


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has, whatever the case of letters; one for each of ``names``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: White space (Unicode White_Space) as ``\\s`` of the splitting pattern sees it; fixed values.
SPACE = (
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
