"""Table functions for SQL: one row in, any number out; over partitions of a table, with an early end.

``register(spark)`` makes known:

* ``html_page_blocks(table(select page_id, html from pages))``: (page_id, title, block_index, block) as of
  ``html.page_blocks``, in Arrow batches;
* ``claim_form_spans(table(select claim_id, file_id, annotation_json from forms))``: the spans of ``packets.form_spans``;
* ``leading_rows(table(select group, place, value from t) partition by group order by (place), n)``: the first ``n`` rows of each
  group, after which the rest of the group is not read by the function.

Names of input columns may differ; their order counts. Null pages and annotations, and annotations that are no JSON of a
form, give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import SkipRestOfInputTableException

from cairn.functions.html import html_blocks

#: Rows whose pages are taken apart together.
AT_ONCE = 32


class PageBlocks:
    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        for at in range(0, pages.num_rows, AT_ONCE):
            part = pages.slice(at, AT_ONCE)
            rows = []
            for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                title, blocks = html_blocks(html or "")
                rows += [(page, title, k, block) for k, block in enumerate(blocks)]
            page, title, index, block = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.table({"page_id": pa.array(page, pa.int64()), "title": pa.array(title, pa.string()), "block_index": pa.array(index, pa.int64()), "block": pa.array(block, pa.string())})


def spans(annotation: str | None) -> Iterator[tuple]:
    """(field_name, field_value, field_type, bbox, valid_bbox, number) of each block of a form annotation."""
    try:
        form = json.loads(annotation or "")["form"]
    except (ValueError, KeyError, TypeError):
        return
    for place, block in enumerate(form if isinstance(form, list) else []):
        if not isinstance(block, dict):
            continue
        words = [w for w in ((x.get("text") or "").strip(" ") for x in block.get("words") or []) if w]
        label, number = block.get("label") or "unknown", str(block["id"]) if block.get("id") is not None else str(place)
        box = [float(x) for x in block["box"]] if isinstance(block.get("box"), list) else None
        whole = box is not None and len(box) == 4 and box[2] > box[0] and box[3] > box[1]
        yield f"{label}_{number}", (block.get("text") or "").strip(" ") or " ".join(words), label, box, whole, number


class FormSpans:
    def eval(self, row: Row) -> Iterator[tuple]:
        claim, file, annotation = row
        for name, value, label, box, whole, number in spans(annotation):
            yield claim, file, name, value, label, box, whole, f"evidence:document_span:{file}:{number}", value == "" or not whole


class LeadingRows:
    """Instances see one group, in its order."""

    def __init__(self):
        self.seen = 0

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        if self.seen >= n:
            raise SkipRestOfInputTableException("the rows asked for are there")
        self.seen += 1
        group, place, value = row
        yield group, self.seen, place, value


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_page_blocks", F.arrow_udtf(PageBlocks, returnType="page_id bigint, title string, block_index bigint, block string"))
    spark.udtf.register("claim_form_spans", F.udtf(FormSpans, returnType="claim_id string, file_id string, field_name string, field_value string, field_type string, bbox array<double>, valid_bbox boolean, evidence_node_id string, needs_review boolean"))
    spark.udtf.register("leading_rows", F.udtf(LeadingRows, returnType="part string, place int, at string, value string"))
