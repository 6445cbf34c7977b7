"""Near-duplicate documents: exact Jaccard likeness of five-word shingles, candidates by the MinHash bands of line dedup."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from . import linededup
from .common import keep_first

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles that are signed at once.
_CHUNK = 1 << 16


def word_form(text: bytes) -> list[tuple[int, bytes]]:
    """The whole text as one form: words in lower case (A-Z), one blank between them; nothing of wordless texts."""
    form = linededup.normal_form(text)
    return [(0, form)] if form else []


def word_shingles(form: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    words = form.encode().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(linededup.rolled(hashes, min(SHINGLE, len(words))))


def word_keys(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash band keys and agreement bits of the forms' shingle sets."""
    parts, held, size = [], [], 0
    for i, form in enumerate(forms):
        held.append(word_shingles(form))
        size += len(held[-1])
        if size >= _CHUNK or i == len(forms) - 1:
            parts.append((np.concatenate(held), np.array([len(x) for x in held])))
            held, size = [], 0
    return linededup.keys_of(parts)


WORDS = linededup.Kind(word_form, word_shingles, word_keys)


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents without near copies: of each component of likeness one row stays, that of the smallest doc_id (null ids last, then by row keys).

    Rows equal in id and text are copies like any others.  Null and wordless texts
    have no shingles and stay; extra columns are carried as they are.
    """
    texts = linededup.signed(documents, WORDS)
    return keep_first(documents, linededup.told_apart(texts, linededup.classes(documents, texts, similarity, kind=WORDS)))
