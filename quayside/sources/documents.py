"""JSON documents that are arrays of rows, the first row being the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def promote_header(documents: DataFrame, document: str, columns: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """One output row per data row of every document, with the columns the header names.

    Values stay text, so `01` keeps its zero. Each column is found through the document's own
    header, so documents may order their columns differently; a column the header lacks and a
    field a short row lacks are NULL. `row_number` counts the data rows of a document from 1.
    A document that is NULL, malformed or without data rows keeps one row with a NULL `row_number` and
    its `status` (`missing`, `malformed`, `empty`; `ok` otherwise). A row that is no array has no fields.

    Each document is parsed once, into a VARIANT whose rows are exploded; a row's fields are taken
    from its part of it, so nothing is parsed for columns that nobody asks for.
    """
    rows = F.try_variant_get(F.try_parse_json(F.col(f"`{document}`")), "$", "array<variant>")
    kept = [F.col(f"`{c}`") for c in keep]
    parsed = documents.select(*kept, F.col(f"`{document}`").isNull().alias("_null"), rows.alias("_rows"))
    header = F.try_variant_get(F.get("_rows", F.lit(0)), "$", "array<string>")
    headed = parsed.select(*kept, "_null", "_rows", header.alias("_header"))
    places = F.array(*[(F.array_position("_header", name) - 1).cast("int") for name in columns])
    located = headed.select(
        *kept,
        F.when(F.col("_null"), "missing").when(F.col("_rows").isNull(), "malformed").when(F.size("_rows") < 2, "empty").otherwise("ok").alias("status"),
        places.alias("_at"),
        F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))).alias("_data"),
    )
    unfolded = located.select(*kept, "status", "_at", F.posexplode_outer("_data").alias("_pos", "_value"))
    fields = unfolded.select(*kept, "status", "_at", "_pos", F.try_variant_get("_value", "$", "array<string>").alias("_row"))
    return fields.select(
        *kept,
        "status",
        (F.col("_pos") + 1).cast("bigint").alias("row_number"),
        *[F.get("_row", F.get("_at", F.lit(i))).alias(name) for i, name in enumerate(columns)],
    )
