"""Conversation prefix trie by family-first merging.

Conversations whose ids differ by less than the family's size share a base: the first h original turns
of the base stand before a member's own turns from h on (h is drawn from the id, at most BORROWED - 1).
The first turns of bases are cogrouped with the turns of their families, so a task sees one family at a
time: it rebuilds the members and builds the family's small trie. Turns travel as 128-bit digests of role
and text with a word count, never as texts, and a node is the 128-bit digest of its parent and its turn.
Only the nodes of families shuffle to be merged over all families, with counts that have been combined
in the family. A merged node belongs to the family of its smallest member; there what a subtree sums up
(leaves, saved tokens) runs from the leaves to the root in a second visit, as every node above stands in
that family too, and the sums merge like the counts.

Ids of the conversations that end in a node come in numeric order: a family is an interval of ids, so its
ids are joined in the family, those of SPAN families in one row, and only a node with more than that is
digested over several rows, one after the other.

Defined results: turns are ordered by turn (null first), then by the digest of role and text, so repeated
rows stay repeated; null role or text is empty; rows without conv_id form no conversation; a conversation
whose base is absent borrows nothing, and one without turns counts at the root alone; an empty table gives
an empty result; other columns are not read. A family's turns (32 bytes each) must fit a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import WORD, attach, shared_folder, written

FAMILY = 20
BORROWED = 4
#: Families whose ids of a node make one row.
SPAN = 1024
ROOT = bytes(16)
NODE = "node binary, parent binary, base long, depth int, words int, n_convs long, conv_id long, ends string"


def borrowed(conv_id: int, most: int = BORROWED) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % most


def turn_rows(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """(base, conv_id, turn, digest, words) of all rows with an id; % keeps the id's sign."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), whole.alias("whole"), text.alias("text")).select(
        (F.col("conv_id") - F.col("conv_id") % family).alias("base"), "conv_id", "turn",
        F.substring(F.unhex(F.sha2("whole", 256)), 1, 16).alias("digest"), F.regexp_count("text", F.lit(WORD)).alias("words"))


def _ordered(table) -> dict[int, list[tuple]]:
    """The turns of each conversation of an Arrow table, in order."""
    chats: dict[int, list[tuple]] = {}
    for conv, turn, digest, words in zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "words")), strict=True):
        chats.setdefault(conv, []).append((turn is not None, turn or 0, digest, words))
    for chat in chats.values():
        chat.sort()
    return chats


def _family_trie(head, members, most: int):
    """The nodes of one family. head: the turns of its base that may be borrowed; members: all its turns."""
    import pyarrow as pa

    first = [turn for chat in _ordered(head).values() for turn in chat]
    nodes: dict[bytes, list] = {}
    base = None
    for conv, chat in sorted(_ordered(members).items()):
        base = members.column("base")[0].as_py() if base is None else base
        h = borrowed(conv, most)
        node, parent = ROOT, None
        rebuilt = first[:h] + chat[h:]
        for depth in range(len(rebuilt) + 1):
            digest, words = rebuilt[depth - 1][2:] if depth else (b"", 0)
            if depth:
                parent, node = node, hashlib.sha256(node + digest).digest()[:16]
            got = nodes.setdefault(node, [node, parent, base, depth, words, 0, conv, []])
            got[5] += 1
        got[7].append(str(conv))
    columns = list(zip(*[(*n[:7], ",".join(n[7]) or None) for n in nodes.values()], strict=True)) or [[]] * 8
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in NODE.split(", ")]
    return pa.table({n: pa.array(c, type=k) for n, c, k in zip(names, columns, kinds, strict=True)})


def family_nodes(turns: DataFrame, family: int = FAMILY, most: int = BORROWED) -> DataFrame:
    """A row for each node of each family: node, parent, base, depth, words, n_convs, smallest member, ids that end there."""
    rows = turn_rows(turns, family)
    heads = rows.filter("conv_id = base")
    return heads.groupBy("base").cogroup(rows.groupBy("base")).applyInArrow(partial(_family_trie, most=most), NODE)


def _subtrees(table):
    """Sums over the subtrees of one family's trie: from the deepest nodes to the root."""
    import pyarrow as pa

    nodes, parents, depths, leaves, saved = (table.column(c).to_pylist() for c in ("node", "parent", "depth", "leaf", "own"))
    at = {node: i for i, node in enumerate(nodes)}
    for i in sorted(range(len(nodes)), key=depths.__getitem__, reverse=True):
        if parents[i] is not None:
            leaves[at[parents[i]]] += leaves[i]
            saved[at[parents[i]]] += saved[i]
    return pa.table({"node": pa.array(nodes, pa.binary()), "leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64())})


def _long_digests(batches: Iterator) -> Iterator:
    """(node, ends_sha256) of rows (node, span, ids) that come sorted; a node may reach over batches."""
    import pyarrow as pa

    def out(node, digest):
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()])})

    node, digest = None, None
    for batch in batches:
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                yield out(node, digest)
            node, digest = key, hashlib.sha256(ids.encode())
    if node is not None:
        yield out(node, digest)


def end_digests(nodes: DataFrame, family: int = FAMILY, span: int = SPAN) -> DataFrame:
    """(node, ends_sha256) for nodes with ends, from family rows (node, base, ends)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"]), ",")
    spans = (nodes.filter("ends is not null").withColumn("span", F.expr(f"base div {family * span}"))
             # div goes towards zero, so the spans on both sides of it are one; their ids keep their order
             .groupBy("node", "span").agg(joined.alias("ids")))
    counts = spans.groupBy("node").agg(F.count(F.lit(1)).alias("spans"))
    # more than one span: so few nodes that SPAN families share each of them
    several = counts.filter("spans > 1").select("node")
    one = spans.join(several, "node", "left_anti").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    long = spans.join(several, "node", "left_semi").repartition("node").sortWithinPartitions("node", "span")
    return one.unionByName(long.select("node", "ids").mapInArrow(_long_digests, "node binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame, family: int = FAMILY, most: int = BORROWED) -> DataFrame:
    """The merged trie, a row for each distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    folder = shared_folder(spark, "trie")
    parts = written(family_nodes(turns, family, most), f"{folder}/families")
    total = parts.count()
    merged = parts.groupBy("node").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("families"))
    children = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(merged.join(children, "node", "left").select(
        "node", "parent", "depth", "words", "n_convs", "conv_id", "families", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), f"{folder}/nodes")
    facts = nodes.select("node", F.col("conv_id").alias("least"), "families", (F.col("n_children") == 0).cast("long").alias("leaf"),
                         ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    mine = F.col("least") - F.col("least") % family == F.col("base")
    zero = F.lit(0).cast("long")
    owned = attach(parts.select("base", "node", "parent", "depth"), facts, "node", "families", total).select(
        "base", "node", "parent", "depth", F.when(mine, F.col("leaf")).otherwise(zero).alias("leaf"), F.when(mine, F.col("own")).otherwise(zero).alias("own"))
    sums = owned.groupBy("base").applyInArrow(_subtrees, "node binary, leaves long, saved long").groupBy("node").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    roots = nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).drop("parent")
    below = attach(nodes.filter("parent is not null"), above, "parent", "n", total).drop("parent", "n")
    return (below.unionByName(roots).join(sums, "node").join(end_digests(parts.select("node", "base", "ends"), family), "node", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


ORACLE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tab),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
t AS (SELECT conv_id, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) AS n FROM t),
x AS (SELECT c.conv_id, 0 AS part, o.n, said, words FROM c JOIN o ON o.conv_id = c.base AND o.n <= c.h
  UNION ALL SELECT c.conv_id, 1, o.n, said, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.n > c.h),
r AS (SELECT conv_id, row_number() OVER w AS d, words, string_agg(sha256(said), '') OVER w AS path FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, max(d) OVER (PARTITION BY conv_id) = d AS last FROM r),
n AS (SELECT path, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM m GROUP BY path),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path),
s AS (SELECT r.path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) OVER w AS leaves, sum((f.n_convs - 1) * f.words) OVER w AS saved
  FROM r LEFT JOIN f ON r.path = f.path AND r.conv_id = f.conv_id WINDOW w AS (PARTITION BY r.conv_id ORDER BY r.d DESC)),
g AS (SELECT path, CAST(sum(leaves) AS BIGINT) AS n_leaves, CAST(coalesce(sum(saved), 0) AS BIGINT) AS saved_tokens FROM s GROUP BY path)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, g.n_leaves, g.saved_tokens, f.ends AS ends_sha256
FROM f JOIN g ON f.path = g.path LEFT JOIN f AS p ON f.d > 0 AND p.path = left(f.path, length(f.path) - 64)
"""
