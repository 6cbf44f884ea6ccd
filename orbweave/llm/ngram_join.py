"""N-gram Jaccard join: prefix candidates, size bands, bitmap bounds, exact sorted-array overlap.

Documents with equal shingle sets are one class, so copies are never compared. Two classes with
similarity of at least 3/4 must share a shingle of their prefixes: of the larger set the first quarter,
of the smaller one the first seventh, in one order of all shingles. The order puts shingles that many
documents hold last, so prefixes are made of rare ones. Classes that share one are compared inside tiles
of a shingle and a size band (sizes of linked sets differ by a factor of 4/3 at most, so a class meets
its own band and the next). There, the place of the shared shingle in both orders bounds the overlap, as
if it were the first one shared: what is shared stands from there on. Then hashed bitmaps bound the
overlap from above: each bit of one bitmap that the other lacks is a shingle not shared. Only pairs that
pass are verified, by intersecting sorted arrays of hashes.

It goes in two rounds. First each class is verified against the few with which it shares most prefix
shingles, among those that stand first or just before it in its tiles. There the order is by the place
of the shared shingle, so first come the classes with the fewest rare shingles of their own, that is,
the texts that others were edited from; that joins groups of copies without looking at all their pairs. Then all remaining candidates between different components are verified, so
no link between components is lost. Holders of a shingle that very many have stand in two of its groups
in the first round, by two hashes of their class, so no group is large and yet all hang together.
Components merge along verified links by joins, in rounds of pointer doubling.

Defined results: words are compared with A-Z in lower case; a text of one to four words is one
shingle; null and empty texts have none and are linked with nothing; a null doc_id is no smallest
id unless its component has no other; rows that repeat an id are rows of their own; an empty table
gives an empty result; other columns are not read (or pass through, when one row a group is kept).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.bloom import BLOCK, NEED_BITS, asked, build, filter_blocks, needed
from orbweave.llm.common import remove, shared_folder, small_batches, written
from orbweave.llm.textops import U, column_bytes, mix, pieces, shingles, words
from orbweave.operators.components import connected_components

#: Similarity of at least NUM / DEN links.
NUM, DEN = 3, 4
#: A shingle in this many documents is common, and comes last in the order of shingles ...
COMMON = 64
#: ... unless more than so many would be; then only the most common ones are.
MOST_COMMON = 1 << 20
#: Shingles whose holders are counted together by one task, about.
RANGE_SHINGLES = 1 << 20
#: Bits of the longest bitmap.
MOST_BITS = 16384
#: Bitmaps of up to so many words of 64 bits go along into tiles; longer ones meet only the pairs that come out.
SIGNATURE = 8
#: Holders of a shingle that stand before one in its order, and such that stand first, are counted as its partners in round one ...
NEAR, FIRST = 8, 4
#: ... of which so many, those with most shingles in common, are verified.
TRIED = 3
#: Holders of a shingle that stand in one group of round one, about.
GROUP = 4096
#: Members that are verified against one class in one group.
STAR = 256
#: Ids are broadcast up to this many, else joined by a shuffle.
BROADCAST_IDS = 50_000


# --- which shingles are common -----------------------------------------------------------------

def _encode_gaps(values: np.ndarray) -> bytes:
    """Sorted integers as gaps of a byte each; 255 stands for a longer way."""
    gaps = np.diff(values, prepend=0)
    longer = gaps // 255
    out = np.full(int(longer.sum()) + len(gaps), 255, dtype=np.uint8)
    out[np.cumsum(longer + 1) - 1] = gaps % 255
    return out.tobytes()


def _decode_gaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    return np.cumsum(steps)[steps < 255]


def _sets(batch_column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For portions of a batch: its first row, and sorted distinct (row, shingle) of its texts."""
    data, offsets = column_bytes(batch_column)
    for first, last in pieces(offsets):
        runs, of = shingles(*words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
        order = np.lexsort((runs, of))
        runs, of = runs[order], of[order]
        if len(runs):
            new = np.concatenate(([True], (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])))
            runs, of = runs[new], of[new]
        yield first, last, runs, of


def _fresh(classes: np.ndarray, seen: set) -> np.ndarray:
    """Which classes this task meets for the first time; seen grows by 8 bytes for each class of the task."""
    out = np.zeros(len(classes), dtype=bool)
    for i, c in enumerate(classes.tolist()):
        if c not in seen:
            seen.add(c)
            out[i] = True
    return out


def _slots(batches: Iterator, slot_bits: int, range_bits: int) -> Iterator:
    """Texts to (range, gaps): the slots of all shingles, once for each class that has them (and each task)."""
    import pyarrow as pa

    def flush():
        slots = np.sort(np.concatenate(held))
        ranges = slots >> (slot_bits - range_bits)
        cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
        low = slots & ((1 << (slot_bits - range_bits)) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(ranges[cuts].astype(np.int64)), pa.array([_encode_gaps(p) for p in np.split(low, cuts[1:])], pa.binary())], names=["range", "gaps"])

    held, size, seen = [], 0, set()
    for batch in batches:
        for first, last, runs, of in _sets(batch.column(0)):
            _, class_ = _class_of(last - first, runs, of)
            runs = runs[_fresh(class_, seen)[of]]
            held.append((runs >> U(64 - slot_bits)).astype(np.int64))
            size += len(runs)
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def common_slots(docs: DataFrame, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(slot bits, sorted slots of common shingles, how many hold them): MOST_COMMON numbers at most.

    total: the sizes of all sets.
    """
    import pyarrow as pa

    slot_bits = min(40, max(20, (total * 2).bit_length()))
    range_bits = max(0, min(slot_bits - 10, (total // RANGE_SHINGLES).bit_length()))
    width = 1 << (slot_bits - range_bits)
    common = max(COMMON, total // MOST_COMMON + 1)

    def count(key, table):
        held = np.zeros(width, dtype=np.int64)
        for gaps in table.column("gaps").to_pylist():
            held += np.bincount(_decode_gaps(gaps), minlength=width)
        slot = np.flatnonzero(held >= common)
        return pa.table({"slots": pa.array([(slot + key[0].as_py() * width).tobytes()], pa.binary()), "held": pa.array([held[slot].tobytes()], pa.binary())})

    blobs = docs.select("text").mapInArrow(partial(_slots, slot_bits=slot_bits, range_bits=range_bits), "range long, gaps binary")
    found = blobs.groupBy("range").applyInArrow(count, "slots binary, held binary").filter("octet_length(slots) > 0").collect()
    slots, held = (np.frombuffer(b"".join(bytes(r[k]) for r in found), dtype=np.int64) for k in (0, 1))
    order = np.argsort(slots)
    return slot_bits, slots[order], held[order]


# --- classes and their prefixes ----------------------------------------------------------------

CLASS = "doc_id long, th long, n long, class long, bitmap array<long>"
PREFIX = "shingle long, salt long, class long, n long, pos long"


def _class_of(count: int, runs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and class (a hash of the whole set, whatever its order) of each text."""
    n = np.bincount(of, minlength=count)
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(runs), dtype=U)))
    ends = np.cumsum(n)
    total = sums[ends] - sums[ends - n]
    return n, mix(total ^ (n.astype(U) * U(0x9E3779B97F4A7C15))).view(np.int64)


def _bitmaps(n: np.ndarray, runs: np.ndarray, of: np.ndarray):
    """A bitmap of each set, of the power of two bits that reaches twice its size (64 to MOST_BITS)."""
    import pyarrow as pa

    bits = np.clip(2 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64, MOST_BITS)
    begin = np.cumsum(bits) - bits
    flat = np.zeros(int(bits.sum()), dtype=bool)
    flat[begin[of] + ((mix(runs + U(77)) >> U(40)).astype(np.int64) & (bits[of] - 1))] = True
    offsets = np.concatenate(([0], np.cumsum(bits // 64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.packbits(flat, bitorder="little").view(np.int64)))


def _classes(batches: Iterator) -> Iterator:
    """Rows (doc_id, th, text) to CLASS."""
    import pyarrow as pa

    for batch in batches:
        for first, last, runs, of in _sets(batch.column(2)):
            n, class_ = _class_of(last - first, runs, of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(n.astype(np.int64)), pa.array(class_), _bitmaps(n, runs, of)],
                names=[c.split()[0] for c in CLASS.split(", ")])


def _prefixes(batches: Iterator, slot_bits: int, common) -> Iterator:
    """Texts to PREFIX: the first shingles of each set, of which a linked set shares one, and their places from 0.

    Each task gives a class once. Holders of a very common shingle come twice, with an even and an odd salt from 2 on.
    """
    import pyarrow as pa

    many, held = common.value
    seen: set = set()
    for batch in batches:
        for first, last, runs, of in _sets(batch.column(0)):
            n, class_ = _class_of(last - first, runs, of)
            fresh = _fresh(class_, seen)
            late = holders = np.zeros(len(runs), dtype=np.int64)
            if len(many):
                slot = (runs >> U(64 - slot_bits)).astype(np.int64)
                at = np.minimum(np.searchsorted(many, slot), len(many) - 1)
                late = many[at] == slot
                holders = np.where(late, held[at], 0)
                order = np.lexsort((runs, late, of))
                runs, holders = runs[order], holders[order]
            size = np.where(fresh & (n > 0), n - (n * NUM + DEN - 1) // DEN + 1, 0)
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            take = pos + np.repeat(np.cumsum(n) - n, size)
            shingle, class_, n, groups = runs[take].view(np.int64), np.repeat(class_, size), np.repeat(n, size), holders[take] // GROUP + 1
            hot = np.flatnonzero(groups > 1)
            salt = np.zeros(len(take), dtype=np.int64)
            own = mix(class_[hot].view(U))
            salt[hot] = 2 + 2 * ((own >> U(33)).astype(np.int64) % groups[hot])
            again = 3 + 2 * ((own & U(0x7FFFFFFF)).astype(np.int64) % groups[hot])
            both = lambda x: pa.array(np.concatenate((x, x[hot])))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [both(shingle), pa.array(np.concatenate((salt, again))), both(class_), both(n), both(pos)], names=[c.split()[0] for c in PREFIX.split(", ")])


# --- exact verification ------------------------------------------------------------------------

def _linked(batches: Iterator) -> Iterator:
    """Rows (a, part, is_leader, b, text), each leader before its members: the pairs (a, b) that link."""
    import pyarrow as pa

    own = np.zeros(0, dtype=U)
    for batch in batches:
        leaders, classes = [], []
        names, leads, members = (batch.column(i).to_pylist() for i in (0, 2, 3))
        for first, last, runs, of in _sets(batch.column(4)):
            begin = np.searchsorted(of, np.arange(last - first + 1))
            for i in range(first, last):
                row = runs[begin[i - first] : begin[i - first + 1]]
                if leads[i]:
                    own = row.copy()
                    continue
                both = len(np.intersect1d(own, row, assume_unique=True))
                if DEN * both >= NUM * (len(own) + len(row) - both):
                    leaders.append(names[i])
                    classes.append(members[i])
        yield pa.RecordBatch.from_arrays([pa.array(leaders, pa.int64()), pa.array(classes, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, holders: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """The pairs (a, b) of classes that link, written at path. holders: (class, doc_id, th); docs: (doc_id, th, text).

    One text of each class at hand is sent to the groups that need it, and hashed again there; a
    group is a class a and at most about STAR of the classes it is paired with.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    role = lambda leads, c: F.struct(F.lit(leads).alias("is_leader"), F.col(c).alias("class"))
    roles = (pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.explode(F.array(role(True, "a"), role(False, "b"))).alias("role"))
             .select("a", "part", "role.*").distinct())
    sent = written(roles.join(holders.select("class", F.col("doc_id").alias("of"), F.col("th").alias("of_th")), "class"), f"{path}-sent")
    texts = needed(docs, sent.select(F.col("of_th").alias("h")), sent.count()).join(sent, (F.col("th") == F.col("of_th")) & F.col("doc_id").eqNullSafe(F.col("of")))
    return written(texts.select("a", "part", "is_leader", F.col("class").alias("b"), "text").repartition("a", "part")
                   .sortWithinPartitions("a", "part", F.col("is_leader").desc()).mapInArrow(_linked, "a long, b long"), path)


def _few(ids: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


# --- the join ----------------------------------------------------------------------------------

def _bound_holds(x: str, y: str, nx: str, ny: str) -> str:
    """Whether two sets can link: the overlap is at most each size less the bits that only it has.

    The bits of a set of twice as many are folded upon themselves first.
    """
    fold = lambda p, q: f"if(size({p}) > size({q}), transform(sequence(0, size({q}) - 1), i -> {p}[i] | {p}[i + size({q})]), {p})"
    only = lambda p, q: f"aggregate(zip_with({fold(p, q)}, {fold(q, p)}, (u, v) -> bit_count(u & ~v)), 0, (s, c) -> s + c)"
    return f"least({nx} - {only(x, y)}, {ny} - {only(y, x)}) * {NUM + DEN} >= {NUM} * ({nx} + {ny})"


def promising(pairs: DataFrame, holders: DataFrame, path: str) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and bitmaps allow a link, written at path."""
    side = lambda name: holders.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"map_{name}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    allowed = sized.filter(_sizes_allow("n_a", "n_b")).filter(_bound_holds("map_a", "map_b", "n_a", "n_b"))
    return written(allowed.select("a", "b"), path)


def _sizes_allow(na: str, nb: str) -> str:
    return f"({na} * {DEN} >= {nb} * {NUM} and {nb} * {DEN} >= {na} * {NUM})"


def _can_start(na: str, pa: str, nb: str, pb: str) -> str:
    """Whether a shingle at places pa and pb can be the first one that two linked sets share.

    All that they share then stands from there on in both, and has to be enough for their sizes.
    """
    return f"(least({na} - {pa}, {nb} - {pb}) * {NUM + DEN} >= {NUM} * ({na} + {nb}))"


#: Whether a shingle can be the first one that a set shares with a linked set that is no smaller.
STARTS = _can_start("n", "pos", "n", "pos")


def _either_way() -> list:
    return [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]


def _band():
    return F.floor(F.log(DEN / NUM, F.col("n") + 0.01)).cast("int").alias("band")


def _merged(first: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """first (class, root) after more links (a, b), written in folder; classes that are alone are not in first."""
    known = _few(first)
    of = lambda c: known.select(F.col("class").alias(c), F.col("root").alias(f"root_{c}"))
    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct())
    moved = connected_components(written(between, f"{folder}/{name}-between"), f"{folder}/{name}-between-roots")
    to = _few(moved)
    old = first.join(to.toDF("root", "to"), "root", "left").select("class", F.coalesce("to", "root").alias("root"))
    new = moved.join(known.select(F.col("class").alias("node")), "node", "left_anti").select(F.col("node").alias("class"), "root")
    return written(old.unionAll(new), f"{folder}/{name}")


def classify(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(rows, holders, roots, folder) of docs (doc_id, th, text), th being a hash of the text: (doc_id, th, n, class)
    of each row, (class, doc_id, th) of the row with the smallest id in each class with words, and (class, root)
    of the classes that link with another one. These are tables in the folder and stay there, as results read them."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "ngram-join")
    rows = written(docs.select("doc_id", "th", "text").mapInArrow(_classes, CLASS), f"{folder}/rows")
    last = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    holders = written(rows.filter("n > 0").groupBy("class").agg(
        F.min(last).alias("one"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")).select("class", "one.doc_id", "one.th", "n", "bitmap"), f"{folder}/holders")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slot_bits, *common = common_slots(docs, total)
    shared = spark.sparkContext.broadcast(common)

    # dealt by shingle once; a shingle is of use if it can be the first that one of its holders shares with another
    prefixes = docs.select("text").mapInArrow(partial(_prefixes, slot_bits=slot_bits, common=shared), PREFIX)
    along = Window.partitionBy("shingle", "salt").orderBy("pos", "n", "class")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("class", "n", "pos")
    others = F.array_distinct(F.concat(F.collect_list(one).over(along.rowsBetween(-NEAR, -1)), F.array_compact(F.array(*[F.nth_value(one, k + 1).over(whole) for k in range(FIRST)]))))
    held = written(
        prefixes.repartition("shingle", "salt").distinct()
        .withColumn("many", F.count(F.lit(1)).over(whole)).withColumn("starts", F.count_if(F.expr(STARTS)).over(whole))
        .filter("salt > 0 or many > 1 and starts > 0").withColumn("others", others)
        .withColumn("near", F.expr(f"transform(filter(others, x -> x.class <> class and {_sizes_allow('x.n', 'n')} and {_can_start('x.n', 'x.pos', 'n', 'pos')}), x -> x.class)"))
        .select("shingle", "salt", "class", "n", "pos", "near"), f"{folder}/held")
    shared.destroy()

    # round one: each class against the few with which it shares most
    most = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    nearest = (held.select(F.explode("near").alias("a"), F.col("class").alias("b")).groupBy("a", "b").count()
               .withColumn("place", F.row_number().over(most)).filter(F.col("place") <= TRIED)
               .groupBy(*_either_way()).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.*"))
    tried = promising(nearest, holders, f"{folder}/tried")
    links = verify(tried, holders, docs, f"{folder}/first")
    # one link a class makes the trees, and of the others those between trees merge them
    trees = connected_components(links.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), f"{folder}/trees").toDF("class", "root")
    first = _merged(trees, links, folder, "roots")

    # round two: what is left between components, in tiles of a shingle and a size band. Of the component
    # that most holders of a shingle are in, members meet others only, so that a large one is not paired with itself
    rooted = (held.filter("salt % 2 = 0").select("shingle", "class", "n", "pos").join(_few(first), "class", "left")
              .withColumn("root", F.coalesce("root", "class")))
    mixed = (rooted.groupBy("shingle", "root").count().groupBy("shingle")
             .agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("shingle", "main"))
    tiles = written(
        rooted.join(mixed, "shingle").select("shingle", "class", "n", "pos", "root", _band(), (F.col("root") == F.col("main")).alias("main"))
        .join(holders.select("class", F.when(F.size("bitmap") <= SIGNATURE, F.col("bitmap")).alias("bitmap")), "class"), f"{folder}/tiles")
    side = lambda c: [F.col("class").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "pos", "root", "main", "bitmap")]]
    lower = tiles.filter(STARTS).select("shingle", F.col("band").alias("tile"), *side("a"))
    upper = tiles.select("shingle", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("tile"), *side("b"))
    meet = lambda x, y: (x.join(y, ["shingle", "tile"])
                         .filter(f"root_a <> root_b and (n_a < n_b or n_a = n_b and a < b) and {_sizes_allow('n_a', 'n_b')} and {_can_start('n_a', 'pos_a', 'n_b', 'pos_b')}"
                                 f" and coalesce({_bound_holds('bitmap_a', 'bitmap_b', 'n_a', 'n_b')}, true)").select("a", "b"))
    left = meet(lower, upper.filter("not main_b")).unionAll(meet(lower.filter("not main_a"), upper.filter("main_b"))).distinct()
    fresh = left.select("a", "b", *_either_way()).join(tried.select(*_either_way()), ["low", "high"], "left_anti").select("a", "b")
    rest = promising(fresh, holders, f"{folder}/rest")
    roots = _merged(first, verify(rest, holders, docs, f"{folder}/second"), folder, "merged")
    for name in ("held", "tried", "first-sent", "first", "trees", "roots-between", "roots-between-roots", "roots", "tiles", "rest", "second-sent", "second", "merged-between", "merged-between-roots"):
        remove(spark, f"{folder}/{name}")
    return rows.select("doc_id", "th", "n", "class"), holders.select("class", "doc_id", "th"), roots, folder


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def component_rows(docs: DataFrame) -> DataFrame:
    """The rows of op2: doc_id, n_shingles, component_id."""
    rows, holders, roots, _ = classify(_prepared(docs))
    rooted = holders.join(roots, "class")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = rooted.join(least, "root").select("class", "least")
    ids = holders.join(linked, "class", "left").select("class", F.coalesce("least", "doc_id").alias("component_id"))
    return (rows.filter("n > 0").join(ids, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionAll(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row with the smallest doc_id
    stays, and every row without words. All columns stay."""
    rows, holders, roots, folder = classify(_prepared(docs))
    rooted = holders.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    keep = rooted.groupBy("root").agg(F.min(order).alias("one")).select("root", F.col("one.doc_id").alias("keep_id"), F.col("one.th").alias("keep_th"))
    kept_by = rooted.join(keep, "root").select("class", "keep_id", "keep_th")
    goes = (rows.filter("n > 0").join(kept_by, "class")
            .select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))).alias("stays"))
            .groupBy("_id", "_th", "stays").agg(F.count(F.lit(1)).alias("copies")).filter("not stays or copies > 1"))
    judged = written(goes, f"{folder}/judged")
    same = F.col("_id").eqNullSafe(F.col("row.doc_id").cast("long")) & (F.col("_th") == F.col("h"))
    # only rows that may have to go meet the list of those that do
    wrapped = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    blocks = min(filter_blocks(judged.count()), NEED_BITS // BLOCK)
    flagged = asked(wrapped, "h", build(judged.select(F.col("_th").alias("h")), blocks), blocks, NEED_BITS)
    kept = flagged.filter(~F.col("maybe")).select("row").unionAll(flagged.filter("maybe").join(judged, same, "left_anti").select("row"))
    again = judged.filter("stays")
    if not again.isEmpty():  # rows that repeat id and text
        kept = kept.unionAll(wrapped.join(again, same).groupBy("_id", "_th").agg(F.max("row").alias("row")).select("row"))
    return kept.select("row.*")
