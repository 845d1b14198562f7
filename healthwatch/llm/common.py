"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from healthwatch.session import ship_package, write_table  # noqa: F401  (re-exported)

#: A word is a maximal run of characters other than these six blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Columns of the physical row id added by :func:`with_row_id`.
RID = ["__row_file", "__row_pos"]

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text of a row; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (native; no empty entries)."""
    return F.filter(F.split(text, BLANKS), lambda w: w != F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``:
    a lambda over a one-element array, which Catalyst never duplicates."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Plan nodes that pass a scan's rows on at most once each.
_PASSING = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "DataSourceV2Relation", "ResolvedHint"}


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only projects and filters one scan.  What multiplies,
    combines or picks rows (explode, union, join, limit, ...) does not."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _PASSING:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def _stable_id(df: DataFrame, keep: list[str]) -> DataFrame:
    meta = df.metadataColumn("_metadata")
    return df.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(meta["file_path"]).alias(RID[0]),
                     meta["row_index"].alias(RID[1]))


def with_row_id(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus a physical row id (file, position).

    The id comes from the scanned parquet file, so it is the same in every
    plan that reads the table again and after a task is recomputed; repeated
    rows and null keys stay apart.  An input that is not a plain scan of parquet
    files (rows multiplied, joined, limited, ...) is written to the shared
    checkpoint folder first, once per DataFrame, so all reads of it agree."""
    if _is_scan(df):
        try:
            out = _stable_id(df, keep)
            out.schema
            return out
        except AnalysisException:  # a scan without file positions
            pass
    if not hasattr(df, "_stored_rows"):
        df._stored_rows = write_table(df, "rows")
    return _stable_id(df._stored_rows, keep)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on equally named keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


#: Rows up to which a side may be broadcast after its count was read from a
#: written table (two or three longs a row: at most about 50 MB).
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join hint from a counted size: broadcast a written table of at most
    ``limit`` rows, else ask for a sort-merge join, which adaptive execution
    splits on hot keys."""
    return F.broadcast(table) if table.count() <= limit else table.hint("merge")


def map_arrow(df: DataFrame, func, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(func, schema)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so
    when the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
