"""Fuzzy line deduplication by MinHash.

Lines are compared as sets of character shingles.  A line's signature is cut
into bands; lines that agree on a band are candidates, candidates are verified
by the exact Jaccard likeness of their shingle sets, and verified links are
joined into components by distributed union-find.  Of each component the first
line, by doc_id and place, stays.

Texts are parsed and signed once into a table of line occurrences: 128-bit
identities, places, and the bands of lines that the task has not signed before.
Texts are read again only to fetch the lines of plausible pairs.

Lines that meet in a band are not expanded into all pairs.  The first round
compares a bucket's lines with its smallest; the next one compares the lines
outside a bucket's largest component with a few inside it.  Each later round
takes some of the lines that are still outside as centres and compares the
bucket's lines of other components with them, as far as sketches do not rule the
pair out.  A bucket is done once its remaining lines are in one component, so
every two lines that share a band are either compared or already connected: what
banding found is kept whole.  Rounds take CENTRES lines of each bucket and more
as fewer buckets are left, so that a round's pairs stay linear in the lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, free_names, join_split, map_texts, materialize, row_keys, utf8

SHINGLE = 5
SIMILARITY = 0.8
#: Lines at the least similarity share a band with probability 1 - (1 - 0.8^6)^13 = 0.981, short ones too, as empty
#: bins are filled independently; at 0.85 with 0.998, at 0.9 with 0.99999; unlike lines, at 0.08 or so, with 3e-6.
BANDS, BAND_ROWS = 13, 6
#: One bit of each of this many bins is kept, to rule out pairs that met by chance before their texts are fetched.
AGREE_BITS = 64
#: With at most this probability a pair at the least similarity differs in more of those bits than is let through.
AGREE_MISS = 1e-6
#: Lines that a band may have for each to be held against all others' agreement bits.
SMALL = 64
CENTRES = 4
#: Rounds after the first in which outsiders meet CENTRES lines of the largest component, before they meet all.
REPRESENTED = 1
#: Bits of the filter that spares unwanted bands and lines the shuffle.
FILTER_BITS = 1 << 26
#: Keys that a task sorts at once, and about as many as one group of their ranges has.
SORTED_KEYS = 1 << 18
#: Characters that are signed at once.
_CHUNK = 1 << 17
_EMPTY = np.uint32(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_LONG = (1 << 64) - 1
#: Further deals of a line's shingles into the bins still empty, before each of those takes a minimum over the whole line.
REDEALS = 10
#: Distinct lines a task remembers so as not to sign them again.
MEMO = 150_000
#: 64-bit words of a line's sketch, which rules out unlike pairs of the later rounds.
SKETCH_WORDS = 16
#: Pairs whose texts one group has, about, and how many are compared at once.
GROUP_PAIRS, COMPARED = 4096, 64
#: Bytes of the texts that one group has, about, without its centres.
GROUP_BYTES = 8 << 20
#: Shingles that a task remembers while it compares lines: 16 MB.
MEMO_SHINGLES = 2_000_000


#: A-Z in lower case and every ASCII blank but the newline as a space.
_PLAIN = bytes(0x20 if b in b"\t\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal_form(line: bytes) -> bytes:
    """What lines are compared by: A-Z lower-cased, runs of ASCII blanks as one, none at the ends."""
    return b" ".join(line.lower().split())


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-character shingles; a shorter line is one shingle."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(rolled(points, min(k, len(points)))) if len(points) else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS longs: bit i is the parity of how many shingles fall on it.

    Two sketches differ in at most as many bits as the sets differ in shingles.
    """
    odd = np.bincount((hashes % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """False only where the sketches of two lines prove their Jaccard likeness to be below similarity."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col(f"{a}.sketch")[0].bitwiseXOR(F.col(f"{b}.sketch")[0])))
    return differ * (1 + similarity) <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (1 - similarity) + 1e-6


def _most_bits(similarity: float) -> int:
    """The fewest bits that a pair of that similarity exceeds with probability AGREE_MISS at most: a bit differs with half the unlikeness."""
    p, n = (1 - similarity) / 2, AGREE_BITS
    tail = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return next((m for m in range(n + 1) if sum(tail[m + 1 :]) <= AGREE_MISS), n)


def rolled(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k values in a row: a polynomial, folded."""
    base, n, p = np.uint64(_BASE), len(points) - k + 1, points + np.uint64(1)
    if k == 5:
        two = p[:-1] * base + p[1:]
        four = two[:-2] * np.uint64(_BASE * _BASE & _LONG) + two[2:]
        out = four[:-1] * base + p[4:]
    else:
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * base + p[i : i + n]
    return out ^ (out >> np.uint64(29))


def line_keys(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, agreement bits) of non-empty lines: int64 arrays of shape (n, BANDS) and (n,)."""
    parts, at = [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= _CHUNK):
            size += len(lines[end])
            end += 1
        parts.append(_line_values(lines[at:end], k))
        at = end
    return keys_of(parts)


def _line_values(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles of all lines in a row and how many each has."""
    # One run of code points, each line filled up to k characters; shingles that span lines are left out.
    lengths = np.array([len(x) for x in lines])
    padded = np.maximum(lengths, k)
    joined = "".join(lines if lengths.min() >= k else [x if len(x) >= k else x.ljust(k, "\0") for x in lines])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    values = rolled(points, k)
    counts = padded - k + 1
    ends = np.cumsum(padded)[:-1]
    inside = np.ones(len(values), bool)
    for back in range(1, k):
        inside[ends - back] = False
    return values[inside], counts


def keys_of(parts: list[tuple[np.ndarray, np.ndarray]], bands: int = BANDS, rows: int = BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, agreement bits) of sets in parts: runs of 64-bit hashes, counts[i] > 0 of the i-th; repeats do not matter."""
    least = _minima(parts, bands * rows)
    columns = least.astype(np.uint64).reshape(len(least), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(least), 1))
    for row in range(rows):
        keys ^= columns[:, :, row]
        keys *= np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(31)
    bits = np.packbits((least[:, :AGREE_BITS] & np.uint32(1)).astype(np.uint8), axis=1)
    return keys.view(np.int64), bits.view(np.int64).ravel()


def _minima(parts: list[tuple[np.ndarray, np.ndarray]], bins: int) -> np.ndarray:
    """(sets, bins) minima: one permutation deals a set's hashes into the bins, where their low halves compete.

    Bins left empty are filled by more permutations, over the sets that have such
    bins only: by bins of their own for REDEALS rounds, then by one minimum a bin
    over the whole set.  A bin agrees in two sets with a probability of their
    likeness, independently of other bins, however small the sets are.
    """
    least, open_, at = [], [], 0
    for values, counts in parts:
        values = values ^ (values >> np.uint64(32))
        values *= np.uint64(0xFF51AFD7ED558CCD)
        values ^= values >> np.uint64(32)
        own = _dealt(values, counts, bins)
        still = (own == _EMPTY).any(axis=1)
        if still.any():
            values, sizes, mine = values[np.repeat(still, counts)], counts[still], own[still]
            mine = np.where(mine == _EMPTY, _dealt(_mixed(values, 1), sizes, bins), mine)
            own[still] = mine
            left = (mine == _EMPTY).any(axis=1)
            open_.append((values[np.repeat(left, sizes)], sizes[left], at + np.flatnonzero(still)[left]))
        least.append(own)
        at += len(own)
    least = np.concatenate(least)
    if not open_:
        return least
    values, sizes, left = (np.concatenate(x) for x in zip(*open_, strict=True))
    for deal in range(2, REDEALS + 2):
        if not len(left):
            return least
        own = least[left]
        if deal <= REDEALS:
            own = np.where(own == _EMPTY, _dealt(_mixed(values, deal), sizes, bins), own)
        else:
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for column in np.flatnonzero((own == _EMPTY).any(axis=0)).tolist():
                low = np.minimum.reduceat(_mixed(values, deal + column).astype(np.uint32), starts)
                own[:, column] = np.where(own[:, column] == _EMPTY, low, own[:, column])
        least[left] = own
        still = (own == _EMPTY).any(axis=1)
        values, left, sizes = values[np.repeat(still, sizes)], left[still], sizes[still]
    return least


def _dealt(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    at = values >> np.uint64(32)
    at *= np.uint64(bins)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += np.repeat(np.arange(len(counts)) * bins, counts)
    least = np.full(len(counts) * bins, _EMPTY, np.uint32)
    np.minimum.at(least, at, values.astype(np.uint32))
    return least.reshape(-1, bins)


def _mixed(values: np.ndarray, number: int) -> np.ndarray:
    """The values under the numbered one of a row of unrelated permutations of 64 bits."""
    out = values * np.uint64((number * _BASE & _LONG) * 2 + 1 & _LONG)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _line_forms(text: bytes) -> list[tuple[int, bytes]]:
    found = []
    for number, line in enumerate(text.translate(_PLAIN).split(b"\n")):
        if b"  " in line or line[:1] == b" " or line[-1:] == b" ":
            line = b" ".join(line.split())
        if line:
            found.append((number, line))
    return found


class Kind(NamedTuple):
    """What is compared: the (place, form)s a text holds, the sorted distinct shingle hashes of a form, and the forms' keys and bits."""

    forms: Callable[[bytes], list[tuple[int, bytes]]]
    shingles: Callable[[str], np.ndarray]
    keys: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


LINES = Kind(_line_forms, shingles, line_keys)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two columns of longs."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def signed(documents: DataFrame, kind: Kind = LINES) -> DataFrame:
    """Every line with content, stored: row, row2 (its document's keys), doc_id, line_no, line, line2 (XXH3-128 of its form), bits, bands.

    A task leaves bands empty for lines that it has just signed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen = xxhash.xxh3_128_digest, set()
        for batch in batches:
            if len(seen) > MEMO:
                seen.clear()
            owners, numbers, digests, fresh, at = [], [], [], [], []
            for owner, text in enumerate(utf8(batch.column("text"))):
                for number, form in kind.forms(text):
                    d = digest(form)
                    if d not in seen:
                        seen.add(d)
                        at.append(len(digests))
                        fresh.append(form.decode())
                    owners.append(owner)
                    numbers.append(number)
                    digests.append(d)
            keys, own = kind.keys(fresh) if fresh else (np.empty((0, BANDS), np.int64), np.empty(0, np.int64))
            ends, bits = np.zeros(len(digests) + 1, np.int32), np.zeros(len(digests), np.int64)
            ends[np.array(at, np.int64) + 1] = BANDS
            bits[at] = own
            places = pa.array(owners, pa.int32())
            columns = [batch.column(c).take(places) for c in ("row", "row2", "doc_id")]
            columns += [pa.array(numbers, pa.int32()), *map(pa.array, _halves(digests)), pa.array(bits)]
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel())))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "row2", "doc_id", "line_no", "line", "line2", "bits", "bands"])

    texts = documents.where("text is not null").select(F.col("doc_id").cast("long"), "text", *row_keys())
    return materialize(map_texts(texts, run, "row long, row2 long, doc_id long, line_no int, line long, line2 long, bits long, bands array<long>"), "linededup-signed")


def bitmap_of(wanted: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS bits that has the bit of every wanted value: 8 MB whatever the input."""
    at = F.pmod(column, F.lit(FILTER_BITS))
    return _bitmap(wanted.select((at / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bits")))


def _bitmap(words: DataFrame) -> np.ndarray:
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return bits.view(np.uint64)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned values have their bit set."""
    at = values % np.uint64(FILTER_BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _extremes(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the least lo and the greatest hi of each."""
    if not len(keys):
        return keys, lo, hi
    order = np.argsort(keys)
    keys = keys[order]
    starts = _starts(keys)
    return keys[starts], np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def several(lines: DataFrame, column: str, keys: int) -> np.ndarray:
    """A bitmap as of bitmap_of with the keys (hashes) that several lines have.

    lines: line and the array column of its keys, of which there are about so many.
    A task sorts SORTED_KEYS of its keys at a time and sends each, with its least and
    greatest line, to the group of its range of keys: rows are runs of keys, and a
    key of very many lines is no burden to one group.  Keys are multiplied by an odd
    number first, as the first of a set's ordered hashes lie close together.
    """
    groups = max(1, -(-keys // SORTED_KEYS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def runs() -> pa.RecordBatch:
            found, owners = (np.concatenate(x) for x in zip(*held, strict=True))
            found, lo, hi = _extremes(found, owners, owners)
            group = (found >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
            starts = _starts(group)
            spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True))
            blocks = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (found, lo, lo ^ hi)]
            return pa.RecordBatch.from_arrays([pa.array(group[starts].astype(np.int64)), *blocks], names=["part", "keys", "lo", "apart"])

        for batch in batches:
            own = batch.column(column)
            found = own.flatten().to_numpy().view(np.uint64)
            if len(found):
                held.append((found * np.uint64(_BASE), np.repeat(batch.column("line").to_numpy(), own.value_lengths().to_numpy())))
                size += len(found)
            if size >= SORTED_KEYS:
                yield runs()
                held, size = [], 0
        if held:
            yield runs()

    def told(group: pa.Table) -> pa.Table:
        found, lo, apart = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("lo", np.int64), ("apart", np.int64)))
        found, lo, hi = _extremes(found, lo, lo ^ apart)
        at = np.unique(found[lo != hi] * np.uint64(pow(_BASE, -1, 1 << 64)) % np.uint64(FILTER_BITS))
        words, bits = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
        if len(at):
            starts = _starts(words)
            words, bits = words[starts], np.bitwise_or.reduceat(bits, starts)
        return pa.table({"word": words.astype(np.int32), "bits": bits.view(np.int64)})

    runs_of = lines.select("line", column).mapInArrow(dealt, "part long, keys binary, lo binary, apart binary")
    return _bitmap(runs_of.groupBy("part").applyInArrow(told, "word int, bits long"))


def _met(lines: DataFrame) -> DataFrame:
    """(band, line, bits) of the bands that several lines have, each once, and maybe a few more."""
    wanted = several(lines.where("size(bands) > 0"), "bands", lines.count() * BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands").flatten()
            keep = np.flatnonzero(in_bitmap(wanted, bands.to_numpy().view(np.uint64)))
            owner = pa.array(keep // BANDS)
            yield pa.RecordBatch.from_arrays([bands.take(pa.array(keep)), batch.column("line").take(owner), batch.column("bits").take(owner)], names=["band", "line", "bits"])

    return lines.where("size(bands) > 0").select("line", "bits", "bands").mapInArrow(run, "band long, line long, bits long").distinct()


def texts_of(documents: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """(form, line, line2) of the wanted lines and maybe a few more, from one more reading of the texts.

    A bitmap tells which lines are wanted, so nothing is shuffled; lines that
    several tasks read are there several times.
    """
    bits = bitmap_of(wanted, "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen = xxhash.xxh3_128_digest, set()
        for batch in batches:
            if len(seen) > MEMO:
                seen.clear()
            forms = [f for text in utf8(batch.column("text")) for _, f in kind.forms(text)]
            digests = [digest(f) for f in forms]
            lo, hi = _halves(digests)
            among = np.flatnonzero(in_bitmap(bits, lo.view(np.uint64))).tolist()
            keep = [i for i in among if not ((d := digests[i]) in seen or seen.add(d))]
            columns = [pa.array([forms[i] for i in keep], pa.binary()).cast(pa.string()), pa.array(lo[keep]), pa.array(hi[keep])]
            yield pa.RecordBatch.from_arrays(columns, names=["form", "line", "line2"])

    return map_texts(documents.where("text is not null").select("text"), run, "form string, line long, line2 long")


def _sketched(lines: DataFrame, texts: DataFrame, kind: Kind) -> DataFrame:
    """(line, size, sketch) of the lines, which are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [kind.shingles(x) for x in batch.column("form").to_pylist()]
            columns = [batch.column("line"), pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "size", "sketch"])

    found = texts.select("line", "form").join(lines, "line", "left_semi")
    return map_texts(found, run, "line long, size int, sketch array<long>").dropDuplicates(["line"])


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, kind: Kind = LINES, size: int = 0, together: bool = False) -> DataFrame:
    """(src, dst) roots of the pairs (one, other, src, dst) of lines whose shingle sets have at least that Jaccard likeness.

    Pairs are dealt by the other line into groups of about GROUP_PAIRS, or fewer so
    that a group has about GROUP_BYTES of the texts, which have size bytes together.  A line's
    text goes to each group that has it once, however many pairs it is in: the
    others' to one group, the few centres' to many.  together: pairs of one src go to
    one group, or to as few as its pairs and the texts' usual size ask for, so that
    long texts are not sent to more groups as there are more of them.  A task holds
    the texts of one group at a time.  Should two texts ever have one 64-bit line, neither is similar
    to any.
    """
    pairs = materialize(pairs.distinct(), "linededup-pairs")
    n = pairs.count()
    groups = max(1, -(-n // GROUP_PAIRS), -(-size // GROUP_BYTES))
    if together and groups > 1:
        # A pair brings about as many bytes as all texts have over all pairs.
        most = max(1, min(GROUP_PAIRS, GROUP_BYTES * n // max(1, size)) // 8)
        parts = pairs.groupBy("src").agg(F.count("*").alias("n"))
        dealt = join_split(pairs, parts, ["src"], ["other"], n).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "other"), F.ceil(F.col("n") / most)))
        dealt = dealt.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), "src", "part"), F.lit(groups))).select(*pairs.columns, "g")
    else:
        dealt = pairs.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), "other"), F.lit(groups)))
    wanted = dealt.select("g", F.explode(F.array("one", "other")).alias("line")).distinct()
    sent = wanted.join(texts.select("line", "form"), "line").select("g", F.lit(0).alias("step"), F.col("line").alias("one"), F.lit(0).cast("long").alias("other"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), "form")
    rows = sent.unionByName(dealt.select("g", F.lit(1).alias("step"), "one", "other", "src", "dst", F.lit(None).cast("string").alias("form")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, forms, known, held = None, {}, {}, 0

        def hashes(line: int) -> np.ndarray:
            nonlocal held
            if line not in known:
                if held > MEMO_SHINGLES:
                    known.clear()
                    held = 0
                form = forms[line]
                known[line] = kind.shingles(form) if form else np.array([line], np.int64).view(np.uint64)
                held += len(known[line])
            return known[line]

        for batch in batches:
            gs, steps, ones = (batch.column(c).to_numpy() for c in ("g", "step", "one"))
            keep = np.zeros(len(gs), bool)
            fresh = (gs[1:] != gs[:-1]) | (steps[1:] != steps[:-1]) | ((ones[1:] != ones[:-1]) & (steps[1:] == 1))
            starts = np.flatnonzero(np.concatenate(([True], fresh))).tolist() if len(gs) else []
            others = batch.column("other").to_numpy()
            for start, end in zip(starts, [*starts[1:], len(gs)], strict=True):
                if gs[start] != group:
                    group, held = gs[start], 0
                    forms.clear()
                    known.clear()
                if steps[start] == 0:
                    for line, form in zip(ones[start:end].tolist(), batch.column("form").slice(start, end - start).to_pylist(), strict=True):
                        if forms.setdefault(line, form) != form:
                            forms[line] = ""
                    continue
                own = hashes(int(ones[start]))
                for at in range(start, end, COMPARED):
                    sets = [hashes(i) for i in others[at : min(end, at + COMPARED)].tolist()]
                    sizes = np.array([len(x) for x in sets])
                    found = np.concatenate(sets)
                    same = own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
                    both = np.add.reduceat(same, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
                    keep[at : at + len(sets)] = both >= similarity * (sizes + len(own) - both) - 1e-9
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("src").filter(mask), batch.column("dst").filter(mask)], names=["src", "dst"])

    return rows.repartition("g").sortWithinPartitions("g", "step", "one").mapInArrow(run, "src long, dst long")


def _split(members: DataFrame, centres: int) -> tuple[DataFrame, DataFrame]:
    """(outsiders, representatives): members outside their buckets' largest components, and centres lines at most of each of those.

    Counts and limits are taken before the shuffle, so a large bucket is never in one task.
    """
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    told = members.join(largest, "band").withColumn("inside", F.col("root") == F.col("largest")).drop("largest")
    order = Window.partitionBy("band").orderBy(F.xxhash64("band", "line"), "line")
    inside = told.where("inside").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= centres)
    return told.where("not inside").drop("inside"), inside.drop("inside", "rank")


def _centres(outside: DataFrame, centres: int) -> DataFrame:
    """The outsiders whose lines are centres now.

    Each bucket names centres lines, and a line named by one bucket is a centre in
    all that it is an outsider of, so that it meets another line once.
    """
    order = Window.partitionBy("band").orderBy(F.xxhash64("line"), "line")
    named = outside.select("band", "line", F.row_number().over(order).alias("rank")).where(F.col("rank") <= centres)
    return outside.join(named.select("line").distinct(), "line", "left_semi")


def _members(met: DataFrame, similarity: float) -> DataFrame:
    """(band, line, lo, n, close) of the lines other than lo that may have a partner in their band; lo is the band's smallest such line, n counts all.

    In a band of SMALL lines at most, a line goes if it differs from all others in
    more agreement bits than a similar pair would; larger bands are kept whole.
    close tells whether the line may be similar to lo.
    """
    most = _most_bits(similarity)
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= most
    buckets = met.groupBy("band").agg(F.count("*").alias("n"), F.min("line").alias("lo"), F.min_by("bits", "line").alias("lo_bits")).where("n > 1")
    told = join_split(met, buckets, ["band"], ["line"], met.count()).withColumn("alone", F.when(F.col("n") > SMALL, F.col("line")))
    small, band = F.col("alone").isNull(), Window.partitionBy("band", "alone")
    told = told.withColumn("peers", F.size(F.filter(F.collect_list("bits").over(band), lambda b: near(b, F.col("bits"))))).where(~small | (F.col("peers") > 1))
    for name, least in (("lo_bits", F.min_by("bits", "line")), ("lo", F.min("line")), ("n", F.count("*"))):
        told = told.withColumn(name, F.when(small, least.over(band)).otherwise(F.col(name)))
    told = told.where("line <> lo").withColumn("close", near(F.col("bits"), F.col("lo_bits"))).where("close or n > 2")
    return told.select("band", "line", "lo", "n", "close")


def classes(documents: DataFrame, lines: DataFrame, similarity: float = SIMILARITY, centres: int = CENTRES, kind: Kind = LINES) -> DataFrame:
    """(line, line2, root) of the lines that were compared with another; root names their component.

    lines: the documents' signed table.
    """
    met = materialize(_met(lines), "linededup-met")
    members = materialize(_members(met, similarity), "linededup-members")
    discard(met)
    # The first round's centre is a bucket's smallest line: one pair a member.
    pairs = members.where("close").select(F.col("lo").alias("one"), F.col("line").alias("other"), F.col("lo").alias("src"), F.col("line").alias("dst"))
    wanted = members.select("line").union(members.where("close").select("lo")).distinct()
    texts = materialize(texts_of(documents, wanted, kind), "linededup-texts")
    size = texts.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    # A root for each line; line2 tells which text a line is, should two ever share it.
    roots = texts.groupBy("line").agg(F.min("line2").alias("line2")).withColumn("root", F.col("line"))
    left, budget, rounds, old = members.where("n > 2").select("band", "line"), centres * members.count(), 0, [members]
    while True:
        found = materialize(similar_pairs(pairs, texts, similarity, kind, size).distinct(), "linededup-links")
        moved = components(found, "linededup").toDF("old", "new")
        roots = materialize(roots.join(moved, roots.root == moved.old, "left").select("line", "line2", F.coalesce("new", "root").alias("root")), "linededup-roots")
        # Buckets whose lines are in more than one component go on; centres, which have met all of their bucket, do not.
        rest = left.join(roots.select("line", "root"), "line")
        open_ = rest.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
        rest = materialize(rest.join(open_, "band").select("band", "line", "root"), "linededup-left")
        n = rest.count()
        discard(found, *old)
        if not n:
            return roots
        if rounds == 0:  # later rounds look at some of these lines
            sketches = materialize(_sketched(rest.select("line").distinct(), texts, kind), "linededup-sketches")
        members = rest.join(sketches, "line")
        outside, inside = _split(members, centres)
        outside, left = materialize(outside, "linededup-outside"), rest.select("band", "line")
        old = [roots, rest, outside]
        if rounds < REPRESENTED:
            members, chosen = inside, outside
        else:
            chosen = materialize(_centres(outside, max(centres, budget // n)), "linededup-centres")
            left = left.join(chosen.select("band", "line"), ["band", "line"], "left_anti")
            old.append(chosen)
        rounds += 1
        a, b = members.alias("a"), chosen.alias("b")
        unlike = (F.col("a.line") != F.col("b.line")) & (F.col("a.root") != F.col("b.root"))
        pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & unlike & _may_be_similar("a", "b", similarity)).select(
            F.col("b.line").alias("one"), F.col("a.line").alias("other"), F.least("a.root", "b.root").alias("src"), F.greatest("a.root", "b.root").alias("dst")
        )


def told_apart(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(row, row2, line_no, stays) of every occurrence in a class of several; the first by (doc_id, row keys, place) stays, null ids last.

    Occurrences are counted by line and lines by class first, so only those of
    classes with several occurrences are looked at one by one; a common line or a
    large class is dealt into parts wherever its rows are joined.
    """
    each = lines.groupBy("line", "line2").agg(F.count("*").alias("times"))
    # A class is named by its root; a line that was compared with none by its own 128 bits.
    named = each.join(roots, ["line", "line2"], "left").select("line", "line2", "times", F.coalesce("root", "line").alias("c1"), F.when(F.col("root").isNull(), F.col("line2")).otherwise(0).alias("c2"))
    named = materialize(named, "linededup-named")
    whole = named.groupBy("c1", "c2").agg(F.sum("times").alias("whole"), F.count("*").alias("n")).where("whole > 1")
    several = join_split(named, whole, ["c1", "c2"], ["line"], named.count()).select("line", "line2", F.col("times").alias("n"), "c1", "c2")
    several = materialize(several, "linededup-several")
    found = join_split(lines.drop("bits", "bands"), several, ["line", "line2"], ["row", "line_no"]).drop("n", "line", "line2")
    found = materialize(found, "linededup-occurrences")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "row2", "line_no")
    first = found.groupBy("c1", "c2").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    return join_split(found, first, ["c1", "c2"], ["row", "line_no"], found.count()).select("row", "row2", "line_no", (at == F.col("first")).alias("stays"))


def removed_lines(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, row2, removed array<int>) of the documents that lose lines, stored."""
    lines = signed(documents)
    gone = told_apart(lines, classes(documents, lines, similarity)).where("not stays")
    return materialize(gone.groupBy("row", "row2").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "linededup-removed")


def _flags(places: str) -> Column:
    """For a column of ascending places: an array that tells of every place up to the last whether it is one of them."""
    gap = f"{places}[i] - if(i = 0, -1, {places}[i - 1]) - 1"
    return F.expr(f"flatten(transform({places}, (x, i) -> concat(array_repeat(false, {gap}), array(true))))")


def deduplicate_lines(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents with near and exact repeats of lines cut from text; other columns as they are, plus n_lines and n_removed.

    A line is what lies between newlines.  Lines are compared without regard to
    A-Z case and runs of blanks; blank lines are never repeats and stay.  A line of
    fewer than 5 characters is one shingle.  Of a component the line with the
    smallest (doc_id, row keys, place) stays, null ids last.  Null texts stay null
    with n_lines 0; empty texts have one blank line.  Rows equal in id and text are
    treated alike.  A column named n_lines or n_removed is replaced.
    """
    # The lists are small beside the texts, which are not sorted for the join.
    keys, (removed, gone) = free_names(documents, "row", "row2"), free_names(documents, "removed", "gone")
    cut = removed_lines(documents, similarity).select("row", "row2", F.size("removed"), _flags("removed")).toDF(*keys, removed, gone)
    joined = documents.withColumns(dict(zip(keys, row_keys(), strict=True))).join(cut.hint("shuffle_hash"), keys, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long"),
            "n_removed": F.coalesce(removed, F.lit(0)).cast("long"),
            "text": F.when(F.col(removed).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")),
        }
    )
    return out.select(*[f"`{c}`" for c in documents.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def cut_documents(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents with repeated lines cut from text and n_chars, where there is one, following.

    Documents all of whose lines with content were repeats go.  Documents that
    had no lines with content to begin with stay as they are.
    """
    out = deduplicate_lines(documents, similarity)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "[ \t\n\x0b\f\r]+", " ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in documents.columns:
        own = dict(documents.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(own)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in documents.columns])
