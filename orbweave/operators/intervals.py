"""The innermost interval around each point, by nested bins instead of comparing points with intervals.

The integers are cut into cells of 2**level, one inside the other. An interval is the union of at most two
cells a level, and of all intervals that cover a cell only the innermost few can be an answer for a point in
it; so each cell keeps those, ranked in the map side's part of a window with a limit. A point lies in one
cell of each level and asks these. Rows grow with the logarithm of the span, never with the number of
intervals around a point, and a key with many points or intervals is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def cells_of(begin: Column, end: Column, levels: int) -> Column:
    """The array of cells (level, cell) whose union is begin..end, both included and not negative."""
    def at(level: Column) -> Column:
        low, high = F.ceil(begin / _power(level)).cast("long"), F.call_function("div", end + 1, _power(level))
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("cell")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("cell")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda c: c.isNotNull())


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, at: str, span: str, begin: str, end: str, apart: bool = False,
              bounds: tuple[int, int] | None = None) -> DataFrame:
    """(point, span): for each point (keys, point, at) the shortest of spans (keys, span, begin, end) that contains at.

    Positions are integers; keys must agree; of equally short spans the one with the smallest name counts. With
    apart, a point is not inside the span of its own name. Points in no span, and those without a position or a
    key, are left out; spans that end before they begin, or have no name or position, contain nothing. All spans
    lie within bounds, first and last position; where these are not known, a pass over the spans finds them.
    """
    spans = spans.filter(F.col(begin) <= F.col(end)).filter(F.col(span).isNotNull())
    size = (F.col(end) - F.col(begin)).cast("long")
    first, last = bounds or spans.agg(F.min(begin), F.max(end)).first()
    if first is None:
        first, last = 0, 0
    top = int(last - first + 1).bit_length()
    levels = top - 1  # larger cells lie in no span
    # level and cell as one number, which makes shorter rows to shuffle
    node = lambda level, cell: _power(F.lit(top) - level) + cell
    place = lambda c: (F.col(c) - F.lit(first)).cast("long")
    covered = F.transform(cells_of(place(begin), place(end), levels), lambda c: node(c.level, c.cell))
    cells = spans.select(*keys, F.col(span).alias("_span"), size.alias("_size"), F.explode(covered).alias("_node"))
    nearest = Window.partitionBy(*keys, "_node").orderBy("_size", "_span")
    few = cells.withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= (2 if apart else 1)).drop("_k")
    chain = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: node(level, F.call_function("div", place(at), _power(level))))
    asked = points.filter(F.col(at).between(F.lit(first), F.lit(last))).select(*keys, point, F.explode(chain).alias("_node"))
    # Spark's estimates leave out that a row explodes to many: without the hint large tables pass for small ones and are broadcast
    found = asked.hint("merge").join(few, [*keys, "_node"])
    if apart:
        found = found.filter(F.col("_span") != F.col(point))
    return found.groupBy(point).agg(F.min(F.struct("_size", "_span")).alias("_best")).select(point, F.col("_best._span").alias(span))
