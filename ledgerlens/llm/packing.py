"""Packing tokenised documents into fixed-length training sequences.

First-fit decreasing with a tournament tree over the free room of open
sequences.  Documents go to randomised groups of bounded expected size and each
group is packed on its own, so groups are independent tasks: a lost one is
recomputed alone, and no task ever sees more than its group's piece lengths.
Token ids never cross the network: pieces are cut while tokenising, and only
(id, start, length) rows are shuffled to be packed.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_texts, materialize

LENGTH = 2048
END_ID = 1
GROUP_DOCUMENTS = 2000
SEED = 7
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, token string"
#: Entries of a worker's word memo before it starts afresh.
MEMO = 600_000

#: What a vocabulary file must say of itself for words to be remembered; with any other its tokenizer reads whole texts.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
# Characters for which lower-casing, blanks and letters are the same to Python and
# to the vocabulary's own rules; texts with any other go to the tokenizer whole.
_ODD = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]|<\\|")
_PARTS = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The public byte-level BPE alphabet: printable bytes as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A vocabulary of the known rules never joins characters across a blank, so the
    ids of a text are those of its blank-separated words in order; words are
    remembered.  Other vocabularies' tokenizers read every text whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.by_word = all(said.get(k) == v for k, v in _KNOWN.items())
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = array.array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()
        self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        parts = self.parts
        return b"".join([parts.get(p) or self._part(p) for p in _PARTS.findall(word)])

    def ids(self, text: str) -> bytes:
        if not self.by_word or _ODD.search(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        split, words = text.lower().split(), self.words
        try:
            return b"".join([words[w] for w in split])
        except KeyError:
            if len(words) > MEMO:
                words.clear()
            if len(self.parts) > MEMO:
                self.parts.clear()
            for w in set(split).difference(words):
                words[w] = self._word(w)
            return b"".join([words[w] for w in split])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(documents: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """Tokenise whole texts and cut them at multiples of length.

    Each id, the end id included, lies in exactly one piece.  A null or empty text
    has only the end id.  token is what a row's group is drawn by: it also has the
    task and how many equal rows the task had before, so that repeated rows are
    spread over groups like any others.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(path).ids, TaskContext.get()
        task, seen = context.partitionId() if context else 0, Counter()
        for batch in batches:
            if len(seen) > MEMO:
                seen.clear()
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                total = len(ids) // 4
                token = f"{doc_id}:{zlib.crc32(ids)}:{total}"
                seen[token] += 1
                token += f":{task}:{seen[token]}"
                for start in range(0, total, length):
                    part = ids[start * 4 : (start + length) * 4]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, token))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "token"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_texts(documents.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


class Tournament:
    """First bin with enough room in O(log n): a complete binary tree of maxima over bins."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        """Take need from the first bin that has it; return that bin."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        tree[at] -= need
        found = at - self.size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; lengths come sorted, longest first."""
    tree, used, out = Tournament(len(lengths), length), {}, []
    for need in lengths:
        found = tree.place(need)
        out.append((found, used.get(found, 0)))
        used[found] = out[-1][1] + need
    return out


def pack(documents: DataFrame, length: int = LENGTH, group_documents: int = GROUP_DOCUMENTS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document longer than a sequence is cut at multiples of length.  Groups are
    drawn by a seeded hash of id, contents and the row's place among equal ones,
    about group_documents documents each.  Pieces of equal length are packed by id and start.  A null or empty
    text is one piece of one id; repeated rows are packed each on its own; an
    empty table gives no rows; a null doc_id is carried as it is.  Other columns
    are ignored.  sequence_id is the group's number times 2^32 plus the bin's.
    """
    cut = materialize(pieces(documents, length, vocabulary), "packing-pieces")
    count = cut.where("start = 0").count()
    groups = max(1, round(count / group_documents))
    keyed = cut.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "token"), F.lit(groups)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = first_fit_decreasing(group["length"].tolist(), length)
        base = int(group["part"].iloc[0]) << 32
        group["sequence_id"] = [base + b for b, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return keyed.groupBy("part").applyInPandas(place, schema)
