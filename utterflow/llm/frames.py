"""Tables and words that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..materialize import saved, shared_dir
from ..operators.ordering import prefix

#: Word characters of the corpus contracts: anything but ASCII white space.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null and blank texts."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_BREAK))


def hash_sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the least seeded hash of their id, as ``rows`` with ``_order``.

    A threshold on the hash, from the row count, leaves about twice as many before
    anything is sorted, so no task sees more than that of a table of any size.
    """
    hashed = rows.withColumn("_order", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 40)))
    share = min(1.0, (2 * n + 100) / max(1, rows.count()))
    return hashed.where(F.col("_order") < int(share * (1 << 40))).orderBy("_order", *rows.columns).limit(n)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def unique_ids(rows: DataFrame, id_col: str) -> bool:
    """Whether no row has a null id or shares its id with another row."""
    ids = rows.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.where("id is null or n > 1").isEmpty()


def numbered(rows: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``rows``, saved, with a dense row number in the order of the ids, null last; rows of one id go by their text's MD5."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    order = [F.col(f"row.`{id_col}`").asc_nulls_last(), F.md5(F.col(f"row.`{text_col}`")), F.col("at")]
    return saved(prefix(packed, order, name=name).select("row.*", name))


def keyed(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``rows`` with a key column that tells rows apart, in the order of the ids, and its name: the id itself if that will do, else a row number."""
    name = free_name(rows, "_row_key")
    if unique_ids(rows, id_col):
        return rows.withColumn(name, F.col(id_col)), name
    return numbered(rows, id_col, text_col, name), name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["WHITE", "WORD_BREAK", "free_name", "hash_sample", "keyed", "numbered", "saved", "shared_dir", "table", "unique_ids", "words"]
