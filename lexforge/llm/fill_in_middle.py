"""Fill-in-middle transformation: DuckDB inside Arrow batches.

A text is cut into units, runs of ASCII letters or single other characters. Two cuts
drawn from a hash of the document's id split the units into prefix, middle and suffix,
and the text is written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm)
behind sentinels, or left plain. Each Arrow batch is registered with a DuckDB
connection of the task and rewritten by one SQL statement, so no row passes through
Python; batches are cut into pieces of about ``PIECE`` bytes of text, since the lists
of units take some thirty times a piece. The longest text alone may exceed that.

``restored`` gets the text back from output and form alone: a text that holds a
sentinel stays plain, and a sentinel has its only "<" in front, so neither a text
nor a joint can hold another one than those that were put in.

Defined results: null text counts as empty; an empty text is plain, with 0 units; a null
id is hashed as an empty one; repeated rows are each transformed, alike; ids may be of
any type and are hashed in their text form; an empty table gives an empty result; other
columns are not read and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The sentinels before prefix, suffix and middle; the pattern of a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"

PIECE = 4 << 20

TRANSFORM = f"""
WITH hashed AS (SELECT place, text, regexp_extract_all(text, '{UNIT}') AS units, sha256($seed || ':' || id) AS h FROM piece),
drawn AS (
  SELECT place, text, units, len(units) AS n, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= $rate THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b FROM drawn),
parts AS (
  SELECT place, text, n, form,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix
  FROM cut)
SELECT place, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
       CASE form WHEN 'plain' THEN text
                 WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                 ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM parts
"""

OUT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive pieces of about ``most`` bytes, of one row at least."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi - lo
        lo = hi


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars and output.

    ``rate`` of a hundred documents are transformed, ``spm`` of a hundred of these have
    the suffix first; the draws depend on seed and id alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    given = {"seed": str(seed), "rate": rate, "spm": spm}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for b in batches:
            ids, names, texts = (b.column(i) for i in range(3))
            for lo, many in pieces(texts):
                piece = pa.table({"place": pa.array(np.arange(many)), "id": names.slice(lo, many), "text": texts.slice(lo, many)})
                con.register("piece", piece)
                made = con.sql(TRANSFORM, params=given).to_arrow_table()
                con.unregister("piece")
                place = made.column("place").to_numpy()
                if (np.diff(place) < 0).any():
                    made = made.take(pa.array(np.argsort(place)))
                out = made.select(OUT.names).cast(OUT).combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, many), *columns], ["doc_id", *OUT.names])

    schema = rows.select("doc_id").withColumns({c: F.lit(None).cast(kind) for c, kind in zip(OUT.names, ("long", "string", "long", "long", "string"), strict=True)}).schema
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>")
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
    )
