"""Source divergence audit by a two-pass vocabulary automaton.

How far each source's use of words lies from the other sources of its language, and which words it uses
more than its language does. Documents are dealt to ranges of (language, source, hash), so a source that
holds most of them has many ranges, and each task cuts its own into blocks of one source of at most BLOCK
characters. Pass one, over a block, finds the distinct terms of each document, and so the exact document
frequency of every term; it leaves the block's terms and its text, lower-cased, blanks for what is no term,
and compressed. Terms in at least LEAST documents of a language are kept. Pass two brings each block the
kept terms that it holds, and an Aho-Corasick automaton of them, each between two delimiters, recounts every
occurrence in the block's text. So neither the vocabulary nor an automaton of all of it is anywhere whole:
memory is bounded by a block.

From then on counts are sparse postings (language, term, source, count). With p(count) of a group depending
on its count alone, the sum over all terms of a language splits into: terms that one of two groups has,
from a histogram of its counts against the other's p(0); terms that neither has, one number; and a
correction for terms that both have, from postings sorted by term. All numbers are integers.

Defined results: null text, language and source are ''; terms are compared after lower-casing A-Z; each
occurring (language, source) is a group, without terms too (its p is the same for all terms; 0 terms give
value 0); a language with one source has no pairs; ties in value are ordered by the item's UTF-8 bytes;
repeated rows count each; an empty table gives an empty result; columns other than text, lang, source,
doc_id are not read. Rows that repeat text and doc_id are in one range, which streams them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import shared_folder, small_batches, written

LEAST = 3
SCALE = 1_000_000_000
TOP = 200
#: Counts up to here, times SCALE, are whole numbers of 64 bits; larger ones take decimals.
FITS = 9_000_000_000
#: Bytes of a block, and of one compressed piece of it, at most (a longer document is a piece, or block, of its own).
BLOCK, PIECE = 16_000_000, 1_000_000
#: Pairs of groups that a task sums up before it writes.
HELD = 200_000
#: Groups are broadcast up to this number (a row of a few numbers each), else joined by a shuffle.
BROADCAST_GROUPS = 20_000

#: What is no part of a term becomes a blank; A-Z become a-z.
PLAIN = bytes(ord(" ") if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _plain(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN)


BLOCKS = "block long, lang string, source string, term string, docs long, text binary"


def _blocks(batches: Iterator, most: int) -> Iterator:
    """Pass one: rows (lang, source, text) come by language and source; gives terms (term, docs) and pieces of text of blocks."""
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    packed = zstandard.ZstdCompressor(level=1).compress
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    of, size, held, docs = None, 0, [], Counter()

    def rows(terms, counts, texts):
        n = max(len(terms), len(texts))
        same = [pa.repeat(pa.scalar(v, k), n) for v, k in ((number, pa.int64()), (of[0], pa.string()), (of[1], pa.string()))]
        own = [pa.array(c, k) if c else pa.nulls(n, k) for c, k in ((terms, pa.string()), (counts, pa.int64()), (texts, pa.binary()))]
        return pa.RecordBatch.from_arrays([*same, *own], names=names)

    def piece():
        whole = packed(b" " + b" ".join(held) + b" ")
        held.clear()
        return rows([], [], [whole])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            if of != (lang, source) or size > most:
                if held:
                    yield piece()
                if docs:
                    yield rows([t.decode() for t in docs], list(docs.values()), [])
                of, size, number = (lang, source), 0, number + 1
                docs.clear()
            terms = _plain(text).split()
            docs.update(set(terms))
            held.append(b" ".join(terms))
            size += len(held[-1]) + 1
            if size // PIECE > (size - len(held[-1]) - 1) // PIECE:
                yield piece()
    if held:
        yield piece()
    if docs:
        yield rows([t.decode() for t in docs], list(docs.values()), [])


POSTING = "lang string, source string, term string, count long"


def _recount(batches: Iterator) -> Iterator:
    """Pass two: rows (block, lang, source, term, text) come by block, kept terms first, then pieces of its text. Gives POSTING."""
    import ahocorasick
    import pyarrow as pa
    import zstandard

    unpacked = zstandard.ZstdDecompressor().decompress
    at, of, automaton, terms = None, None, None, []
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_pydict({"lang": [of[0]] * len(counts), "source": [of[1]] * len(counts), "term": [terms[k] for k in counts], "count": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return batch

    for batch in batches:
        block, lang, source, term, text = (batch.column(c) for c in ("block", "lang", "source", "term", "text"))
        block = block.to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if first == last:
                continue
            if block[first] != at:
                if counts:
                    yield out()
                at, of, automaton, terms = block[first], (lang[first].as_py(), source[first].as_py()), None, []
            here = term.slice(first, last - first)
            behind = last - here.null_count
            terms += here.slice(0, behind - first).to_pylist()
            if behind == last:
                continue
            if automaton is None and terms:
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for k, word in enumerate(terms):
                    automaton.add_word(f" {word} ", k)
                automaton.make_automaton()
            if automaton is not None:
                for piece in text.slice(behind, last - behind).to_pylist():
                    counts.update(map(itemgetter(1), automaton.iter(unpacked(piece).decode())))
    if counts:
        yield out()


def _common_terms(batches: Iterator) -> Iterator:
    """(g, s, value): corrections for terms that two groups have, from rows (lang, term, g, p, p0) sorted by lang and term."""
    import pyarrow as pa

    f = lambda p, q: (p - q) * (p - q) // q
    held: Counter = Counter()

    def settle(rows: dict) -> None:
        same = np.concatenate((rows["same"], [False]))  # whether the next row has the same term
        p, p0, g = rows["p"], rows["p0"], rows["g"]
        a = np.flatnonzero(same)
        d = 1
        found = []
        while len(a):
            b = a + d
            for x, y in ((a, b), (b, a)):
                found.append((g[x], g[y], f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])))
            a = a[same[b]]  # the term goes on behind b
            d += 1
        if found:
            x, y, value = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((y, x))
            x, y, value = x[order], y[order], value[order]
            new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            for pair, total in zip(zip(x[new].tolist(), y[new].tolist(), strict=True), np.add.reduceat(value, new).tolist(), strict=True):
                held[pair] += total

    def out():
        g, s = zip(*held, strict=True)
        batch = pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int64()), "s": pa.array(s, pa.int64()), "value": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return batch

    rest = None
    for batch in batches:
        whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        whole = whole.combine_chunks()
        n = whole.num_rows
        if not n:
            continue
        agree = [np.array([], dtype=bool)] if n == 1 else [whole.column(c).combine_chunks() for c in ("lang", "term")]
        same = agree[0] if n == 1 else np.logical_and(*(c.slice(1).to_numpy(zero_copy_only=False) == c.slice(0, n - 1).to_numpy(zero_copy_only=False) for c in agree))
        cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0  # the last term may go on in the next batch
        settle({"same": same[: max(cut - 1, 0)], **{c: whole.column(c).to_numpy()[:cut] for c in ("g", "p", "p0")}})
        rest = whole.slice(cut)
        if len(held) > HELD:
            yield out()
    if rest is not None and rest.num_rows:
        settle({"same": np.ones(rest.num_rows - 1, dtype=bool), **{c: rest.column(c).to_numpy() for c in ("g", "p", "p0")}})
    if held:
        yield out()


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def postings(docs: DataFrame, folder: str, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(lang, term, source, count) of all kept terms, counted by the automata of blocks; count > 0. Dealt by lang and term."""
    small_batches(docs.sparkSession)
    rows = docs.select(_empty("lang").alias("lang"), _empty("source").alias("source"), _empty("text").alias("text"), F.col("doc_id"))
    dealt = rows.withColumn("h", F.xxhash64("doc_id", "text")).drop("doc_id").repartitionByRange("lang", "source", "h").sortWithinPartitions("lang", "source")
    blocks = written(dealt.select("lang", "source", "text").mapInArrow(partial(_blocks, most=block), BLOCKS), f"{folder}/blocks")
    everywhere = Window.partitionBy("lang", "term")
    terms = blocks.filter("term is not null").withColumn("docs", F.sum("docs").over(everywhere)).filter(F.col("docs") >= least)
    columns = ["block", "lang", "source", "term", "text"]
    sides = terms.select(columns).unionByName(blocks.filter("text is not null").select(columns))
    # one number to sort by: a block's terms, then its text
    counted = sides.repartition("block").sortWithinPartitions(F.expr("block * 2 + int(text is not null)")).mapInArrow(_recount, POSTING)
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"))


def _p(count, n, v) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)); 1 where there are no terms."""
    product = (count + F.lit(1)).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    wide = F.call_function("div", product, (n + v).cast("decimal(28,0)"))
    fits = F.call_function("div", (count + F.lit(1)) * F.lit(SCALE).cast("long"), n + v)
    return F.when(v <= 0, F.lit(1).cast("long")).when(count < F.lit(FITS), fits + 1).otherwise(wide + 1)


def _f(p, q) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank of every group."""
    folder = shared_folder(docs.sparkSession, "divergence")
    # each posting knows its term's count in the language, and one posting of a term stands for it
    of_term = Window.partitionBy("lang", "term")
    counts = written(postings(docs, folder, least).withColumn("stands", F.row_number().over(of_term.orderBy("source")) == 1)
                     .withColumn("count_lang", F.sum("count").over(of_term)), f"{folder}/postings")
    zero = F.lit(0).cast("long")
    size = counts.groupBy("lang").agg(F.count_if("stands").alias("v"), F.sum("count").alias("n_lang"))
    own = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms"))
    occurring = docs.select(_empty("lang").alias("lang"), _empty("source").alias("source")).distinct()
    groups = written(occurring.join(own, ["lang", "source"], "left").join(size, "lang", "left").select(
        F.monotonically_increasing_id().alias("g"), "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "terms", "v", "n_lang")])
        .withColumn("p0", _p(zero, F.col("n"), F.col("v"))), f"{folder}/groups")
    small = F.broadcast if groups.count() <= BROADCAST_GROUPS else lambda df: df
    sized = counts.join(small(groups), ["lang", "source"]).withColumn("p", _p(F.col("count"), F.col("n"), F.col("v")))

    # the terms of a group by how often it has them, against p(0) of the other sources
    shares = sized.groupBy("g", "lang", "p").agg(F.count(F.lit(1)).alias("like"))
    other = groups.select("lang", F.col("g").alias("s"), F.col("p0").alias("q0"), F.col("terms").alias("other_terms"))
    apart = F.col("g") != F.col("s")
    alone = shares.join(small(other), "lang").filter(apart).groupBy("g", "s").agg(
        F.sum(F.col("like") * _f(F.col("p"), F.col("q0"))).alias("to"), F.sum(F.col("like") * _f(F.col("q0"), F.col("p"))).alias("from"))
    first, second = alone.select("g", "s", F.col("to").alias("value")), alone.select(F.col("s").alias("g"), F.col("g").alias("s"), F.col("from").alias("value"))
    neither = groups.join(small(other), "lang").filter(apart).select(
        "g", "s", ((F.col("v") - F.col("terms") - F.col("other_terms")) * _f(F.col("p0"), F.col("q0"))).alias("value"))
    both = (sized.select("lang", "term", "g", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(_common_terms, "g long, s long, value long"))
    name = groups.select("g", "lang", "source")
    pairs = (first.unionByName(second).unionByName(neither).unionByName(both).groupBy("g", "s").agg(F.sum("value").alias("value"))
             .join(small(name), "g").join(small(name.select(F.col("g").alias("s"), F.col("source").alias("item"))), "s").select("lang", "source", "item", "value"))

    terms = (sized.withColumn("q", _p(F.col("count_lang"), F.col("n_lang"), F.col("v"))).filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.select("*", F.lit("pair").alias("part"), F.row_number().over(order).alias("rank")).select(columns)
    return ranked.unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term")).select(columns))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, k.c AS all_c FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL) AS x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.c, CAST(1 + 1000000000::HUGEINT * (c.c + 1) // (n.n + v.v) AS HUGEINT) AS p, CAST(1 + 1000000000::HUGEINT * (c.all_c + 1) // (v.n + v.v) AS HUGEINT) AS q
  FROM c JOIN n ON n.lang = c.lang AND n.source = c.source JOIN v ON v.lang = c.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
