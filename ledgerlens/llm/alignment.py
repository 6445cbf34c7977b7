"""Alignment of the tokens that two tokenizers make of the same texts.

Every byte of a text gets a label: no token ends there, one of A, one of B, or one
of both.  A regular expression reads spans up to each label of both; the labels
inside a span tell how many tokens of A and of B it has, and these are the groups.
Tokens of one group are linked; how many documents hold a linked pair of ids says
which ids of the two vocabularies stand for each other.

Texts are tokenised once.  A document's links are kept as distinct id pairs with
their numbers.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import join_split, map_texts, materialize, utf8
from .packing import byte_letters

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Pairs of one group that are written out one by one; the tokens of larger groups are counted by id first.
WRITTEN = 4096
#: Pairs of ids whose counts every task may hold: at some 30 bytes each.
HELD = 2_000_000
#: Characters whose classes all versions of Unicode that the libraries know agree on; texts with others are tokenised whole.
_ODD = re.compile("[^\t\n\r -~¡-ɏΑ-ΡΣ-ωА-я–—‘-”…ぁ-ゖァ-ヺ一-龥가-힣]")
#: What A's file must say of how it splits texts for its ranks to be used.
_KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: A run of groups of one token each, or a group with ends of its own inside.
_GROUP = re.compile(b"x+|[ab]+x")
_LABELS = bytes.maketrans(b"\1\2\3", b"abx")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class ByteTokens:
    """Byte-level BPE: ids and the bytes of each id.

    Merges whose results are numbered in their order are what a table of ranks
    says, which is read much faster; any other file, and texts with characters
    whose class depends on the library, are left to the file's own tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        vocabulary, merges = said["model"]["vocab"], said["model"]["merges"]
        bytes_of = {letter: byte for byte, letter in byte_letters().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.spelled = [bytes(bytes_of[c] for c in name) if all(c in bytes_of for c in name) else name.encode() for name in names]
        plain = said["normalizer"] is None and said["pre_tokenizer"] == _KNOWN
        ordered = all(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i for i, m in enumerate(merges))
        self.ranks = None
        if plain and ordered:
            ranks = {self.spelled[i]: i for i in vocabulary.values()}
            self.ranks = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceTokens:
    """SentencePiece BPE, which adds a blank before the text: ids and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


def spelled(ids: np.ndarray, names: list[bytes]) -> bytes:
    """The bytes of the ids one after another."""
    return b"".join([names[i] for i in ids.tolist()] if len(ids) < 2 else itemgetter(*ids.tolist())(names))


class Aligner:
    """Both tokenizers and the written forms of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.sizes = [np.array([len(x) for x in t.spelled], np.int64) for t in (self.a, self.b)]
        # A's ids followed by , or |, B's by , or ; in one table.
        self.shift = [0, len(self.a.spelled), 2 * len(self.a.spelled), 2 * len(self.a.spelled) + len(self.b.spelled)]
        self.written = [f"{i}{mark}".encode() for t, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for i in range(len(t.spelled))]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(A's ids, B's ids) of a blank and the text; None for an empty text or one that either does not spell out."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.ids(" " + text), self.b.ids(text)
        # Ranks cut a text into pieces of itself; only what has no rank could be lost, and that is seen from the length.
        exact = self.a.ranks is not None and self.sizes[0][a].sum() == len(whole)
        if not (exact or spelled(a, self.a.spelled) == whole) or spelled(b, self.b.spelled) != whole:
            return None
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group has."""
        ends = [np.cumsum(self.sizes[t][ids]) for t, ids in enumerate((a, b))]
        labels = np.zeros(ends[0][-1], np.uint8)
        labels[ends[0] - 1] |= 1
        labels[ends[1] - 1] |= 2
        written = labels.tobytes().translate(_LABELS, b"\0")  # what has no label is left out
        found = _GROUP.findall(written)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        marks, starts = np.frombuffer(written, np.uint8), np.cumsum(lengths) - lengths
        run = marks[starts] == ord("x")
        inside = np.add.reduceat(marks == ord("a"), starts, dtype=np.int64)
        times = np.where(run, lengths, 1)
        of_a = np.repeat(inside + 1, times)
        return of_a, np.repeat(np.where(run, 1, lengths - inside), times)

    def digest(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> str:
        """sha256 of the groups in order: ids by commas, A before B, groups apart by semicolons."""
        last_a, last_b = np.cumsum(of_a) - 1, np.cumsum(of_b) - 1
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a] = end_b[last_b] = 1
        # A's token comes after all of B's in earlier groups, B's after all of A's up to its own group.
        at_a = np.arange(len(a)) + np.repeat(np.cumsum(of_b) - of_b, of_a)
        at_b = np.arange(len(b)) + np.repeat(np.cumsum(of_a), of_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[at_a] = a + np.where(end_a, self.shift[1], self.shift[0])
        order[at_b] = b + np.where(end_b, self.shift[3], self.shift[2])
        return hashlib.sha256(spelled(order, self.written)[:-1]).hexdigest()


def pair_counts(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a * 2^20 + b, how often they are linked) of the distinct id pairs, sorted."""
    from_a, from_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    large = of_a * of_b > WRITTEN
    n, m = of_a[~large], of_b[~large]
    # Each A token of a group takes the group's B tokens in turn.
    each = np.repeat(m, n)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first_a = np.repeat(from_a[~large], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    keys = [(np.repeat(a[first_a], each) << 20) | b[np.repeat(np.repeat(from_b[~large], n), each) + place]]
    times = [np.ones(len(keys[0]), np.int64)]
    for g in np.flatnonzero(large).tolist():
        (ids_a, n_a), (ids_b, n_b) = np.unique(a[from_a[g] : from_a[g] + of_a[g]], return_counts=True), np.unique(b[from_b[g] : from_b[g] + of_b[g]], return_counts=True)
        keys.append(((ids_a << 20)[:, None] | ids_b[None, :]).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate(times))
    return found, total


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each two vocabularies in a Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def aligned(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Every row's doc_id, numbers of tokens, groups and links, digest of the groups, and its distinct linked id pairs with how often each is linked."""
    paths = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            rows, pairs, times = [], [], []
            for text in batch.column("text").to_pylist():
                found = own.tokens(text or "")
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    pairs.append(np.empty(0, np.int64))
                    times.append(pairs[-1])
                    continue
                of_a, of_b = own.groups(*found)
                keys, n = pair_counts(*found, of_a, of_b)
                rows.append((len(found[0]), len(found[1]), len(of_a), int(of_a @ of_b), own.digest(*found, of_a, of_b)))
                pairs.append(keys)
                times.append(n)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in pairs]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (pairs, times)]
            columns = [batch.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_texts(texts, run, SCHEMA)


def pair_table(rows: DataFrame) -> DataFrame:
    """(pair, count, best): how many rows hold a linked id pair, and whether no other pair of its A id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")).withColumn("a", F.shiftright("pair", 20))
    counts = materialize(counts, "alignment-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # no more rows than A has ids
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a blank and the text, B the text, before which it puts a blank.  Null and
    empty texts, and texts whose bytes either does not spell out again, have no
    tokens: zeros and an empty digest.  A pair's count is the number of rows that
    hold it linked, rows of one id and repeated rows each for themselves; n_best
    counts the links whose pair has its A id's highest count, ties included, and
    count_sum sums the counts over links.  Empty tables give no rows; only doc_id
    and text are read.

    Where the id pairs are no more than held, their counts go to all tasks;
    otherwise both sides are shuffled, common pairs dealt into parts.
    """
    rows = materialize(aligned(documents, path_a, path_b), "alignment-rows")
    table = materialize(pair_table(rows), "alignment-pairs")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    # A row's number is given while the stored rows are read, so it is the same should a task run again.
    each = rows.where("n_links > 0").withColumn("at", F.monotonically_increasing_id()).select("at", *own, F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    each = each.select("at", *own, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    if table.count() <= held:
        told = each.join(F.broadcast(table), "pair")
    else:
        told = join_split(each, table.withColumn("n", F.col("count")), ["pair"], ["at"])
    summed = told.groupBy("at", *own).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    without = rows.where("n_links = 0").select(*own[:5], none.alias("n_best"), none.alias("count_sum"), own[5])
    return summed.select(*own[:5], "n_best", "count_sum", own[5]).unionByName(without)
