"""JSON documents of large tables, as pieces: a header, an entry per row and a trailer for each section, in order.

No row holds a whole section, so a document's size is bounded by the file system alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a section's header and trailer, before and behind those of its entries.
HEAD, TAIL = -1, (1 << 62)


def quoted(c: Column) -> Column:
    """A value as JSON."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


@dataclass
class Section:
    """Entries of ``rows`` in the order of ``idx``: values, or, with ``key``, keys and values."""

    name: str
    rows: DataFrame
    idx: str
    value: Column
    key: Column | None = None

    def pieces(self) -> DataFrame:
        """``idx, value`` of its entries."""
        entry = quoted(self.value) if self.key is None else F.concat(quoted(self.key.cast("string")), F.lit(": "), quoted(self.value))
        return self.rows.select(F.col(self.idx).cast("long").alias("idx"), entry.alias("value"))


def document(sections: list[Section]) -> DataFrame:
    """``section, idx, value``: the pieces of a JSON object that has a list or an object for each section."""
    spark = sections[0].rows.sparkSession
    parts, marks = [], []
    for k, s in enumerate(sections):
        entries = s.pieces()
        first = entries.agg(F.min("idx")).first()[0]
        comma = F.when(F.col("idx") == F.lit(first), "").otherwise(",")
        parts.append(entries.select(F.lit(k).alias("section"), "idx", F.concat(comma, "value").alias("value")))
        opening, closing = ("[", "]") if s.key is None else ("{", "}")
        marks += [(k, HEAD, f'{", " if k else "{"}"{s.name}": {opening}'), (k, TAIL, closing + ("}" if k == len(sections) - 1 else ""))]
    parts.append(spark.createDataFrame(marks, "section int, idx long, value string"))
    return reduce(DataFrame.unionByName, parts)
