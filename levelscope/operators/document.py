"""The session report as one nested document a session, and back to the flat tables it is made of.

A document holds a list of rows for each part (levels, touches, reclaims, watches, moves, ...).
Lists are bounded by what a session can hold: a level has at most as many touches as the day
has ticks. Rows keep the order of the part's own keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY

#: A part's table and the columns that order its rows within a session.
Part = tuple[DataFrame, list[str]]


def session_documents(parts: dict[str, Part], keys: list[str] = KEY) -> DataFrame:
    """A row for each session that any part has rows of: ``keys`` and ``report``, a struct of a list for each part.

    A session without rows of a part has an empty list there. A part's columns must have other
    names than ``keys``, save that it has those too.
    """
    lists = []
    for name, (df, order) in parts.items():
        rest = [c for c in df.columns if c not in (*keys, *order)]
        row = F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])
        lists.append(df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("at"), row.alias("row")))).alias(name)))
    joined = reduce(lambda a, b: a.join(b, keys, "full"), lists)
    empty = F.array()
    report = [F.transform(F.coalesce(F.col(n), empty.cast(joined.schema[n].dataType)), lambda x: x["row"]).alias(n) for n in parts]
    return joined.select(*keys, F.struct(*report).alias("report"))


def document_schema(documents: DataFrame) -> str:
    """The schema by which stored documents are read."""
    return documents.schema["report"].dataType.simpleString()


def part_rows(documents: DataFrame, part: str, keys: list[str] = KEY) -> DataFrame:
    """A part's flat table, as it went into the documents."""
    return documents.select(*keys, F.inline(F.col("report").getField(part)))
