"""One row a type name out of what several files say about it.

Rules look at each file's part of a type for itself; the graph looks at names. So the parts merge by name:
sets of names are united, by distinct pairs that the map side already makes few, and the kind has three values,
where a file that knows it to be a class outweighs one that knows a value, and that one those which don't know.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETS = ("members", "inherited", "attributes")


def merge_types(types: DataFrame, sets: Sequence[str] = SETS) -> DataFrame:
    """(name, is_reference, files, *sets) of types (path, name, is_reference, *sets of strings), a row for each name.

    files counts the paths that name it; sets come in order, without nulls, and are empty rather than null. Rows
    without a name are no type and are left out; repeated rows change nothing.
    """
    named = types.filter("name is not null")
    kinds = named.groupBy("name", "path").agg(F.bool_or("is_reference").alias("is_reference")).groupBy("name").agg(
        F.bool_or("is_reference").alias("is_reference"), F.count("path").alias("files"))
    empty = F.array().cast("array<string>")
    tagged = F.concat(*[F.arrays_zip(F.array_repeat(F.lit(c), F.size(F.coalesce(c, empty))).alias("set"), F.coalesce(c, empty).alias("value")) for c in sets])
    values = named.select("name", F.explode(tagged).alias("v")).select("name", "v.set", "v.value").filter("value is not null").distinct()
    own = lambda c: F.array_sort(F.collect_list(F.when(F.col("set") == c, F.col("value")))).alias(c)
    united = values.groupBy("name").agg(*[own(c) for c in sets])
    return kinds.join(united, "name", "left").select("name", "is_reference", "files", *[F.coalesce(c, empty).alias(c) for c in sets])
