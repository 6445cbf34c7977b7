"""Exact joins of documents by the Jaccard likeness of their word n-grams, by signature trees.

Each distinct text is a set of hashed shingles, put in one order for all: crowded
shingles last, the others by hash.  Two sets of the wanted likeness share one of
the first few of either, so every shingle that several sets have among their
first is the root of a tree over those sets.  Nodes hold the OR of their sets'
token bitmaps and the range of their sizes.  A dual traversal goes down pairs of
nodes at once and leaves a pair of nodes alone as soon as

- their size ranges are too far apart,
- the most tokens that two of their sets can share are too few, or
- all their sets are in one component already.

Pairs of sets that are left, and whose parities may be those of like sets, are
compared on their whole texts.  First the sets of
each tree are compared with its smallest, one pair a set: groups of near copies
are one component after that, and their trees are never gone down.  Levels of all
trees are joined at once, so no tree is in one task, however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linededup
from .common import components, discard, join_split, map_texts, materialize, utf8
from .neardocs import word_form

SHINGLE = 4
PERCENT = 85
#: 64-bit words of a bitmap.
WIDTH = 16
#: A shingle that more sets have among their first stands last in the order, so that fewer have it there.
CROWD = 10
#: Children of a node, sets of a lowest node.
FAN = 8
#: Sets of a tree that one task holds, about; larger trees are cut by their top nodes into such blocks.
BLOCK = 2048
#: Earlier shingles of a set that tell whether a pair has met before.
EARLIER = 4
#: Pairs of nodes or sets that are looked at together.
_AT_ONCE = 1 << 15
#: Distinct texts a task remembers so as not to sign them again.
MEMO = 400_000


def shingles(form: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of words with single blanks; fewer words are one shingle."""
    words = form.encode().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(linededup.rolled(hashes, min(k, len(words))))


def kind_of(k: int) -> linededup.Kind:
    def keys(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError("trees have no bands")

    return linededup.Kind(word_form, lambda form: shingles(form, k), keys)


def prefix_length(size: int, percent: int) -> int:
    """How many of a set's first shingles meet one of another set's at the least likeness: all but so many as must be shared, and one."""
    return size - -(-percent * size // 100) + 1


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """WIDTH longs: a bit for every token, several of which may have one."""
    on = np.zeros(64 * WIDTH, np.uint8)
    on[(hashes >> np.uint64(20)) % np.uint64(64 * WIDTH)] = 1
    return np.packbits(on).view(np.int64)


def _crowded(documents: DataFrame, k: int, percent: int) -> np.ndarray:
    """A bitmap of the shingles that more than CROWD texts have among the first 3/2 * prefix_length by hash.

    It orders shingles and decides no more than that: another one would only make the trees larger or smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > MEMO:
                seen.clear()
            found = [np.empty(0, np.uint64)]
            for text in utf8(batch.column("text")):
                for _, form in word_form(text):
                    if (d := xxhash.xxh3_64_intdigest(form)) not in seen:
                        seen.add(d)
                        own = shingles(form.decode(), k)
                        found.append(own[: 3 * prefix_length(len(own), percent) // 2])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    keys = map_texts(documents.where("text is not null").select("text"), run, "key long")
    return linededup.bitmap_of(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "key")


def signed(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line, line2, n, keys, bits, sketch) of every row, stored.

    line and line2 are XXH3-128 of the words, null without any, and n the size of
    the set.  keys are its first shingles, bits its bitmap and sketch its parities; a
    task leaves all three empty for texts that it has just signed.
    """
    crowd = _crowded(documents, k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            if len(seen) > MEMO:
                seen.clear()
            digests, sizes, keys, bits, sketches = [], [], [], [], []
            for text in utf8(batch.column("text")):
                form = next((f for _, f in word_form(text or b"")), None)
                d = xxhash.xxh3_128_digest(form) if form else None
                digests.append(d)
                own_keys = own_bits = own_sketch = []
                if form and d not in seen:
                    own = shingles(form.decode(), k)
                    seen[d] = len(own)
                    late = linededup.in_bitmap(crowd, own)
                    own_keys = np.concatenate((own[~late], own[late]))[: prefix_length(len(own), percent)].view(np.int64)
                    own_bits, own_sketch = bitmap(own), linededup.sketch(own)
                sizes.append(seen[d] if form else 0)
                keys.append(own_keys)
                bits.append(own_bits)
                sketches.append(own_sketch)
            halves = [None if d is None else np.frombuffer(d, "<i8").tolist() for d in digests]
            lines = [pa.array([None if h is None else h[i] for h in halves], pa.int64()) for i in (0, 1)]
            longs = pa.list_(pa.int64())
            columns = [batch.column("doc_id"), *lines, pa.array(sizes, pa.int64()), pa.array(keys, longs), pa.array(bits, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "line2", "n", "keys", "bits", "sketch"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return materialize(map_texts(texts, run, "doc_id long, line long, line2 long, n long, keys array<long>, bits array<long>, sketch array<long>"), "sigtree-signed")


def _met(sets: DataFrame) -> DataFrame:
    """(key, line, place), stored: the first shingles that several sets have, one of those that the very same sets have.

    Sets that share a passage share many shingles: their trees would be one and the same.
    """
    wanted = linededup.several(sets, "keys", sets.agg(F.sum(F.size("keys"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten()
            sizes = keys.value_lengths().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            place = (np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            keep = np.flatnonzero(linededup.in_bitmap(wanted, flat.to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(keep)), batch.column("line").take(pa.array(owner[keep])), pa.array(place[keep])], names=["key", "line", "place"])

    met = materialize(sets.select("line", "keys").mapInArrow(run, "key long, line long, place int"), "sigtree-shared")
    digest = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("line")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "line")).alias("y")]
    same = met.groupBy("key").agg(*digest).where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    out = materialize(join_split(met, same.select("key", "n"), ["key"], ["line"]).select("key", "line", "place"), "sigtree-met")
    discard(met)
    return out


def _most_common(a: str, b: str) -> Column:
    """The most tokens that a set of node a and one of node b can share: a token of either is on a common bit or was one of several on its own."""
    common = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseAND(F.col(f"{b}.bits")[i])) for i in range(1, WIDTH)), F.bit_count(F.col(f"{a}.bits")[0].bitwiseAND(F.col(f"{b}.bits")[0])))
    return F.least(f"{a}.hi", f"{b}.hi", F.col(f"{a}.slack") + common, F.col(f"{b}.slack") + common)


def _near_enough(a: str, b: str, percent: int) -> Column:
    """False only where the parities of two sets prove them unlike: they differ in no more bits than the sets do in tokens."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(1, linededup.SKETCH_WORDS)), F.bit_count(F.col(f"{a}.sketch")[0].bitwiseXOR(F.col(f"{b}.sketch")[0])))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}.lo") + F.col(f"{b}.lo"))


def _worth(a: str, b: str, percent: int) -> Column:
    """False only where no set of node a can be linked with one of node b that is in another component."""
    one = (F.col(f"{a}.root") == F.col(f"{a}.last")) & (F.col(f"{b}.root") == F.col(f"{b}.last")) & (F.col(f"{a}.root") == F.col(f"{b}.root"))
    far = (100 * F.col(f"{a}.hi") < percent * F.col(f"{b}.lo")) | (100 * F.col(f"{b}.hi") < percent * F.col(f"{a}.lo"))
    enough = (100 + percent) * _most_common(a, b) >= percent * (F.col(f"{a}.lo") + F.col(f"{b}.lo"))
    return ~one & ~far & enough


def _cut(members: DataFrame) -> DataFrame:
    """members with cut: into 2 to the power of how many blocks their tree is cut."""
    counts = members.groupBy("key").agg(F.count("*").alias("n"))
    cut = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int")
    own = members.withColumnRenamed("n", "_n")
    return join_split(own, counts.select("key", "n", cut.alias("cut")), ["key"], ["line"]).drop("n").withColumnRenamed("_n", "n")


def _blocks(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their block, top nodes of the trees that are cut), both stored; block 0 where a tree is one block."""
    # Components are parted first, so that a large one has blocks of its own, then sets.
    path = F.xxhash64("root").bitwiseAND(F.lit(-1 << 60)).bitwiseOR(F.shiftrightunsigned(F.xxhash64("line"), 4))
    block = F.when(F.col("cut") > 0, F.expr("shiftrightunsigned(path, 64 - cut)")).otherwise(0)
    told = materialize(told.withColumn("path", path).withColumn("block", block).drop("path"), "sigtree-members")
    ors = F.array(*(F.bit_or(F.col("bits")[i]) for i in range(WIDTH)))
    ranges = [F.max("slack").alias("slack"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("root").alias("root"), F.max("root").alias("last")]
    nodes = materialize(told.where("cut > 0").groupBy("key", "block").agg(ors.alias("bits"), *ranges), "sigtree-tops")
    return told, nodes


def candidates(members: DataFrame, percent: int = PERCENT, facts: DataFrame | None = None) -> DataFrame:
    """(one, other, src, dst, most) pairs of sets of different components that no node rules out, stored; src and dst are their components, most bounds what they share.

    members: key, line, place (of the key among the set's), root, and n, bits, sketch unless
    facts (line, n, bits, sketch) are given: these are joined once trees are cut, so
    that the wide rows are shuffled once more only.
    A tree of more than BLOCK sets is cut by its top nodes, and pairs of these go
    down only if they are worth it; what is below goes through _below, a pair of
    blocks at a time.
    """
    ones = F.expr("aggregate(bits, 0, (acc, x) -> acc + bit_count(x))")
    before = Window.partitionBy("line").orderBy("place").rowsBetween(-EARLIER, -1)
    told = _cut(members) if facts is None else _cut(members).join(facts, "line")
    shaped = told.select("key", "line", "root", "cut", F.col("n").alias("lo"), F.col("n").alias("hi"), (F.col("n") - ones).alias("slack"), "bits", "sketch", F.collect_list("key").over(before).alias("earlier"))
    told, tops = _blocks(shaped)
    a, b = tops.alias("a"), tops.alias("b")
    large = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")) & _worth("a", "b", percent)).select("a.key", F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    large = materialize(large, "sigtree-blocks")
    columns = ["line", "root", "lo", "slack", "bits", "sketch", "earlier"]
    small = told.where("cut = 0").select("key", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side"), *columns)
    sides = large.select("key", "x", "y", F.explode(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.select("key", "x", "y", F.col("s.block").alias("block"), "s.side").where("x < y or side = 0")
    dealt = told.where("cut > 0").join(sides, ["key", "block"]).select("key", "x", "y", "side", *columns)
    rows = small.unionByName(dealt).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "lo", "root", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("key", "x", "y")]
            fresh = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1
            # A group that goes on from the batch before.
            if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("key", "x", "y")):
                yield from _told(held, percent)
                held = []
            for start, end in zip([0, *fresh.tolist()], [*fresh.tolist(), batch.num_rows], strict=True):
                held.append(batch.slice(start, end - start))
                if end < batch.num_rows:
                    yield from _told(held, percent)
                    held = []
        if held:
            yield from _told(held, percent)

    found = rows.mapInArrow(run, "one long, other long, src long, dst long, most long")
    out = materialize(found.groupBy("one", "other", "src", "dst").agg(F.max("most").alias("most")), "sigtree-candidates")
    discard(told, tops, large)
    return out


def _longs(columns: list[pa.Array], width: int) -> np.ndarray:
    """Arrays of at most width longs as rows of width; what is missing is 0."""
    out = np.zeros((sum(len(c) for c in columns), width), np.int64)
    at = 0
    for column in columns:
        sizes = column.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(column)), sizes)
        out[at + row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
        at += len(column)
    return out


def _told(group: list[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of one group: the sets of a tree, or of two of its blocks."""
    numbers = {c: np.concatenate([b.column(c).to_numpy() for b in group]) for c in ("side", "line", "root", "lo", "slack")}
    bits, sketches, earlier = (_longs([b.column(c) for b in group], width) for c, width in (("bits", WIDTH), ("sketch", linededup.SKETCH_WORDS), ("earlier", EARLIER)))
    one, other, most = _below(numbers, bits, sketches, earlier, percent)
    if len(one):
        line, root = numbers["line"], numbers["root"]
        less = line[one] < line[other]
        a, b = np.where(less, one, other), np.where(less, other, one)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (line[a], line[b], root[a], root[b], most)], names=["one", "other", "src", "dst", "most"])


def _below(sets: dict[str, np.ndarray], bits: np.ndarray, sketches: np.ndarray, earlier: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, other, most) places of pairs that no node rules out, by a dual traversal; sets are in order of side, then size.

    Nodes of FAN children in order, over the sets of either side.  A pair that has
    another shingle in common shortly before this one has met there, or at a
    shingle before that.
    """
    split = int(np.searchsorted(sets["side"], 1))
    two = 0 < split < len(sets["side"])
    levels = [(bits.view(np.uint64), sets["lo"], sets["lo"], sets["slack"], sets["root"], sets["root"])]
    starts = [(0, split if two else len(bits), split, len(bits))]
    while max(starts[-1][1] - starts[-1][0], starts[-1][3] - starts[-1][2]) > 1 or len(levels) == 1:
        a0, a1, b0, b1 = starts[-1]
        cuts = np.concatenate((np.arange(a0, a1, FAN), np.arange(b0, b1, FAN) if two else np.empty(0, np.int64)))
        own, lo, hi, slack, root, last = levels[-1]
        levels.append((np.bitwise_or.reduceat(own, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(slack, cuts), np.minimum.reduceat(root, cuts), np.maximum.reduceat(last, cuts)))
        n_a, n_b = -(-(a1 - a0) // FAN), -(-(b1 - b0) // FAN) if two else 0
        starts.append((0, n_a, n_a, n_a + n_b))
    one, other = np.array([0]), np.array([1 if two else 0])
    for level in range(len(levels) - 1, -1, -1):
        kept = [_kept(levels[level], one[i : i + _AT_ONCE], other[i : i + _AT_ONCE], percent) for i in range(0, len(one), _AT_ONCE)]
        one, other, most = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (one, other, np.empty(0, np.int64))
        if not level or not len(one):
            break
        one, other = _children(one, other, starts[level - 1], starts[level], two)
    pairs = []
    for i in range(0, len(one), _AT_ONCE):
        a, b, m = one[i : i + _AT_ONCE], other[i : i + _AT_ONCE], most[i : i + _AT_ONCE]
        differ = np.bitwise_count(sketches.view(np.uint64)[a] ^ sketches.view(np.uint64)[b]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * differ <= (100 - percent) * (sets["lo"][a] + sets["lo"][b])
        a, b, m = a[near], b[near], m[near]
        met = ((earlier[a][:, :, None] == earlier[b][:, None, :]) & (earlier[a] != 0)[:, :, None]).any(axis=(1, 2))
        pairs.append((a[~met], b[~met], m[~met]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (none, none, none)


def _children(one: np.ndarray, other: np.ndarray, below: tuple[int, int, int, int], above: tuple[int, int, int, int], two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of pairs of nodes, each once."""

    def first(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        in_b = two & (nodes >= above[2])
        start = np.where(in_b, below[2] + (nodes - above[2]) * FAN, below[0] + nodes * FAN)
        return start, np.minimum(start + FAN, np.where(in_b, below[3], below[1]))

    (a0, a1), (b0, b1) = first(one), first(other)
    step = np.arange(FAN)
    a, b = a0[:, None, None] + step[None, :, None], b0[:, None, None] + step[None, None, :]
    keep = (a < a1[:, None, None]) & (b < b1[:, None, None])
    # Below one node of one tree, a pair in either order is the same pair.
    keep &= (one != other)[:, None, None] | (a <= b)
    a, b = np.broadcast_to(a, keep.shape)[keep], np.broadcast_to(b, keep.shape)[keep]
    return a, b


def _kept(nodes: tuple[np.ndarray, ...], one: np.ndarray, other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of nodes worth going down, with the most that two of their sets can share; as _worth and _most_common."""
    bits, lo, hi, slack, root, last = nodes
    joined = (root[one] == last[one]) & (root[other] == last[other]) & (root[one] == root[other])
    far = (100 * hi[one] < percent * lo[other]) | (100 * hi[other] < percent * lo[one])
    keep = ~joined & ~far
    one, other = one[keep], other[keep]
    common = np.bitwise_count(bits[one] & bits[other]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(hi[one], hi[other]), np.minimum(slack[one], slack[other]) + common)
    keep = (100 + percent) * most >= percent * (lo[one] + lo[other])
    return one[keep], other[keep], most[keep]


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(line, root) after links between roots."""
    moved = components(links, "sigtree").toDF("old", "new")
    return materialize(roots.join(moved, roots.root == moved.old, "left").select("line", F.coalesce("new", "root").alias("root")), "sigtree-roots")


def _texts(documents: DataFrame, pairs: DataFrame, kind: linededup.Kind) -> tuple[DataFrame, int]:
    """(the texts of the lines in pairs, stored, how many bytes they have): what is compared is read again, what is not is never shuffled."""
    lines = pairs.select(F.explode(F.array("one", "other")).alias("line")).distinct()
    texts = materialize(linededup.texts_of(documents, lines, kind), "sigtree-texts")
    return texts, texts.agg(F.sum(F.octet_length("form"))).first()[0] or 0


def classes(documents: DataFrame, rows: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(line, root) of the distinct texts that share a first shingle with another; root names their component.

    rows: the documents' signed table.
    """
    kind, similarity = kind_of(k), percent / 100
    sets = materialize(rows.where("size(bits) > 0").dropDuplicates(["line"]).select("line", "n", "keys", "bits", "sketch"), "sigtree-sets")
    met = _met(sets)
    facts = sets.select("line", "n", "bits", "sketch")
    roots = materialize(met.select("line").distinct().withColumn("root", F.col("line")), "sigtree-roots")

    # Each tree's sets with its smallest.
    least = met.groupBy("key").agg(F.min("line").alias("lo"), F.count("*").alias("n")).where("n > 1")
    told = materialize(join_split(met, least, ["key"], ["line"]).where("lo <> line").select("key", "line", "place", "lo", "n"), "sigtree-told")
    stars = told.select(F.col("lo").alias("one"), F.col("line").alias("other")).distinct()
    shaped = facts.select("line", F.col("n").alias("lo"), F.col("n").alias("hi"), (F.col("n") - F.expr("aggregate(bits, 0, (acc, x) -> acc + bit_count(x))")).alias("slack"), "bits", "sketch", F.col("line").alias("root"), F.col("line").alias("last"))
    near = stars.alias("s").join(shaped.alias("a"), F.col("s.one") == F.col("a.line")).join(shaped.alias("b"), (F.col("s.other") == F.col("b.line")) & _worth("a", "b", percent) & _near_enough("a", "b", percent))
    stars = materialize(near.select("s.one", "s.other", F.col("s.one").alias("src"), F.col("s.other").alias("dst")), "sigtree-stars")
    texts, size = _texts(documents, stars, kind)
    linked = materialize(linededup.similar_pairs(stars, texts, similarity, kind, size, True).distinct(), "sigtree-links")
    roots, old = _merged(roots, linked), roots
    discard(linked, old, stars, texts)

    # The trees of more than one component, without the smallest sets, which have met all others.
    rest = told.where("n > 2").select("key", "line", "place").join(roots, "line")
    open_ = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    members = materialize(rest.join(open_, "key").select("key", "line", "place", "root"), "sigtree-open")
    pairs = candidates(members, percent, facts)
    discard(members)
    texts, size = _texts(documents, pairs, kind)
    # A set with the likeliest of each other component first: that joins most components, and their other pairs need no look.
    first = pairs.groupBy("one", "src", "dst").agg(F.max_by("other", F.struct("most", "other")).alias("other")).select("one", "other", "src", "dst")
    linked = materialize(linededup.similar_pairs(first, texts, similarity, kind, size, True).distinct(), "sigtree-links")
    of_root = components(linked, "sigtree").toDF("old", "new")
    a, b = of_root.alias("a"), of_root.alias("b")
    moved = pairs.alias("p").join(a, F.col("p.src") == F.col("a.old"), "left").join(b, F.col("p.dst") == F.col("b.old"), "left")
    left = moved.where(F.coalesce("a.new", "p.src") != F.coalesce("b.new", "p.dst")).select("p.one", "p.other", "p.src", "p.dst")
    left = left.join(first, ["one", "other", "src", "dst"], "left_anti")
    more = linededup.similar_pairs(left, texts, similarity, kind, size, True)
    every = materialize(linked.union(more).distinct(), "sigtree-links")
    found = _merged(roots, every)
    discard(linked, every, roots, texts, told, met, sets, pairs)
    return found


def jaccard_components(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles (distinct k-word shingles), component_id, all long.

    A-Z are lower-cased; words lie between ASCII blanks.  Two documents link when
    100 * intersection >= percent * union of their sets; component_id is the
    smallest doc_id that links reach, itself included.  A text of fewer than k words
    is one shingle.  Null, empty and wordless texts have none and are linked with
    nothing, not even with each other: component_id is their own id, null if that is
    null.  Rows of equal words are linked, whatever their ids; a row without doc_id
    names no component.  Only doc_id and text are read.
    """
    rows = signed(documents, k, percent)
    roots = classes(documents, rows, k, percent)
    texts = rows.where("line is not null").groupBy("line", "line2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = texts.join(roots, "line", "left").select("line", "line2", "least", "n", F.coalesce("root", "line").alias("c1"), F.when(F.col("root").isNull(), F.col("line2")).otherwise(0).alias("c2"))
    named = materialize(named, "sigtree-named")
    whole = named.groupBy("c1", "c2").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    several = join_split(named.drop("n"), whole, ["c1", "c2"], ["line"]).drop("n").join(named.select("line", "line2", "n"), ["line", "line2"])
    told = join_split(rows.where("line is not null").select("doc_id", "line", "line2", F.col("n").alias("n_shingles")), several, ["line", "line2"], ["doc_id"])
    alone = rows.where("line is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return told.select("doc_id", "n_shingles", "component_id").unionByName(alone)
