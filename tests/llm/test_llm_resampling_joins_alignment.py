"""Resampling, signature trees and token alignment against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm import alignment, linededup, queries, resampling, sigtree

from test_llm_operators import SF, awkward_texts, prose, roots_of

CLASHES = "doc_id long, text string, words string, features string, rank string, score string, keys string, bits string, line string, n string, pairs string, at string, root string, whole string"


def plain_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 12) for i, t in rows], CLASHES).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASHES)


# 11: importance resampling


def resampled(rows, target, percent, least, ngrams=2, buckets=10_000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain_lower(t or ""))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]
    of = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(words(t))]
    s, t = Counter(b for _, x in rows for b in of(x)), Counter(b for x in target for b in of(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        found = of(x)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, len(words(x)) >= least])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    take = percent * len(may) // 100
    ranks = {id(r): k + 1 for k, r in enumerate(may[:take])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize(("percent", "least", "ngrams"), [(25, 20, 2), (100, 0, 1), (60, 3, 3), (0, 20, 2)])
def test_resampling_against_plain_python(spark, docs, rows, percent, least, ngrams):
    target = [prose(random.Random(8), 200), None, "", rows[3][1]]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(docs, frame, percent, least, ngrams)
    assert [t for _, t in found.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, found.collect()), key=str) == resampled(rows, target, percent, least, ngrams)


def test_many_equal_rows_have_ranks_of_their_own(spark, none, monkeypatch):
    monkeypatch.setattr(resampling, "RUN", 7)
    rows = [(1, "a b c")] * 50 + [(2, "d e f")] * 9 + [(None, "a b")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = resampling.resample(frame, frame, 90, 1).collect()
    assert sorted(map(tuple, found), key=str) == resampled(rows, [t for _, t in rows], 90, 1)
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(frame, none, 50, 1).where("rank is not null").count() == 32


def test_drawn_documents_keep_their_columns(docs, none):
    told = resampling.resample(docs, docs, 50, 5).where("rank is not null")
    kept = resampling.drawn(docs, docs, 50, 5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in told.collect()}
    assert resampling.drawn(none, docs).count() == 0


# 12: signature trees


def shingle_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", plain_lower(text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)] if words else [])


def joined(rows, percent=85, k=4):
    sets = [shingle_set(t, k) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    groups = defaultdict(list)
    for n, r in roots_of(range(len(rows)), links).items():
        groups[r].append(n)
    least = {n: min((rows[m][0] for m in g if rows[m][0] is not None), default=None) for g in groups.values() for n in g}
    return sorted(((rows[n][0], len(sets[n]), least[n]) for n in range(len(rows))), key=str)


def near_threshold(rng, families=30):
    """Families of texts whose likeness lies about the threshold, with shared passages and a common line."""
    common, rows, i = prose(rng, 12).split(), [], 1000
    for f in range(families):
        base = prose(rng, rng.choice([3, 5, 8, 20, 60, 200])).split() + (common if f % 3 == 0 else [])
        for _ in range(rng.randint(2, 7)):
            words = list(base)
            for _ in range(max(1, int(len(words) * rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])))):
                words[rng.randrange(len(words))] = "".join(rng.choice("abcdef") for _ in range(6))
            rows.append((i, " ".join(words)))
            i += 1
    return rows


@pytest.mark.parametrize(("crowd", "block", "percent", "k"), [(10, 2048, 85, 4), (3, 4, 85, 4), (0, 8, 60, 3), (2, 2, 95, 1)])
def test_signature_trees_against_all_pairs(spark, rows, monkeypatch, crowd, block, percent, k):
    monkeypatch.setattr(sigtree, "CROWD", crowd)
    monkeypatch.setattr(sigtree, "BLOCK", block)
    monkeypatch.setattr(sigtree, "FAN", 2 if block < 5 else 8)
    own = rows + near_threshold(random.Random(9))
    frame = spark.createDataFrame([(i, t, *["x"] * 12) for i, t in own], CLASHES).repartition(5)
    found = sigtree.jaccard_components(frame, k, percent)
    assert [t for _, t in found.dtypes] == ["bigint"] * 3
    assert sorted(map(tuple, found.collect()), key=str) == joined(own, percent, k)


def test_signature_trees_on_empty_tables(spark, none):
    assert sigtree.jaccard_components(none).count() == 0
    frame = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, None), (4, "a"), (5, "A ")], "doc_id long, text string")
    assert sorted(map(tuple, sigtree.jaccard_components(frame).collect()), key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None), (4, 1, 4), (5, 1, 4)], key=str)


@pytest.mark.parametrize(("block", "fan"), [(2048, 8), (2048, 2), (16, 3), (2, 2)])
def test_candidates_hold_every_link_that_shares_a_key(spark, monkeypatch, block, fan):
    monkeypatch.setattr(sigtree, "BLOCK", block)
    monkeypatch.setattr(sigtree, "FAN", fan)
    rng, sets = random.Random(4), []
    for f in range(12):
        base = {rng.getrandbits(64) for _ in range(rng.randint(1, 300))}
        sets += [base | {rng.getrandbits(64) for _ in range(rng.randint(0, len(base) // 8 + 1))} for _ in range(6)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    members = [(7, i, 0, i // 3, len(a), sigtree.bitmap(a).tolist(), linededup.sketch(a).tolist()) for i, a in enumerate(arrays)]
    frame = spark.createDataFrame(members, "key long, line long, place int, root long, n long, bits array<long>, sketch array<long>")
    found = {(r.one, r.other): r.most for r in sigtree.candidates(frame).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i // 3 != j // 3 and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert want and want <= set(found)
    assert all(found[i, j] >= len(sets[i] & sets[j]) for i, j in found)
    assert len(found) < len(sets) ** 2 / 4  # most pairs are ruled out on the way


def test_facts_may_be_joined_once_trees_are_cut(spark):
    rng = np.random.default_rng(5)
    arrays = [np.unique(np.concatenate((np.arange(20), rng.integers(100, 104, 2)))).astype(np.uint64) for _ in range(12)]
    narrow = spark.createDataFrame([(7, i, 0, i) for i in range(12)], "key long, line long, place int, root long")
    facts = spark.createDataFrame([(i, len(a), sigtree.bitmap(a).tolist(), linededup.sketch(a).tolist()) for i, a in enumerate(arrays)], "line long, n long, bits array<long>, sketch array<long>")
    found = sigtree.candidates(narrow, 85, facts).collect()
    assert found and sorted(found) == sorted(sigtree.candidates(narrow.join(facts, "line"), 85).collect())


def test_pairs_dealt_together_are_compared_alike(spark, monkeypatch):
    monkeypatch.setattr(linededup, "GROUP_PAIRS", 16)
    forms = {i: f"one text of many words that {'differs' if i % 3 else 'is as it was'} here and there {i // 3 % 2}" for i in range(40)}
    texts = spark.createDataFrame(list(forms.items()), "line long, form string")
    pairs = spark.createDataFrame([(0, i, 0, i) for i in range(1, 40)] + [(1, i, 1, i) for i in range(2, 9)], "one long, other long, src long, dst long")
    apart, together = (sorted(map(tuple, linededup.similar_pairs(pairs, texts, 0.8, size=5000, together=t).collect())) for t in (False, True))
    assert together and together == apart


def test_group_of_many_near_copies_is_linked_without_all_pairs(spark):
    rng = random.Random(12)
    base = prose(rng, 200).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in sigtree.jaccard_components(frame).collect()} == {0}


# 13: alignment


def aligned_plainly(rows):
    ta = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter = {c: b for b, c in alignment.byte_letters().items()}
    of_b = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    held, docs = Counter(), []
    for i, text in rows:
        groups, n_a, n_b = [], 0, 0
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            bytes_a, bytes_b = [bytes(letter[c] for c in ta.id_to_token(x)) for x in a], [of_b(tb.id_to_piece(x)) for x in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                n_a, n_b = len(a), len(b)
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                cuts, at_a, at_b = sorted(set(ends_a) & set(ends_b)), 0, 0
                for cut in cuts:
                    end_a, end_b = ends_a.index(cut, at_a) + 1, ends_b.index(cut, at_b) + 1
                    groups.append((a[at_a:end_a], b[at_b:end_b]))
                    at_a, at_b = end_a, end_b
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(links.keys())
        text_of = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        docs.append((i, n_a, n_b, len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((i, n_a, n_b, g, m.total(), sum(n for (x, y), n in m.items() if held[x, y] == best[x]), sum(n * held[p] for p, n in m.items()), sha) for i, n_a, n_b, g, m, sha in docs), key=str)


ODD = ["", " ", "  ", "a  b ", "\n\nx\t", "<|endoftext|> <s></s>", "Ünï 日本語 \U0001f600", "x" * 3000, "it's 'll don't", "a b", "é", "▁a", "<0x41>", "end   ", "\U0001f600" * 150, "한국어 текст", "\u0000\u0001", "tab\tand\r\nline", "ﬁ ½"]


@pytest.mark.parametrize(("held", "written"), [(2_000_000, 4096), (0, 4096), (2_000_000, 2)])
def test_alignment_against_plain_python(spark, rows, monkeypatch, held, written):
    monkeypatch.setattr(alignment, "WRITTEN", written)
    own = rows + [(500 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(i, t, *["x"] * 12) for i, t in own], CLASHES).repartition(3)
    found = alignment.align(frame, held=held)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == aligned_plainly(own)


def test_alignment_of_empty_tables(none):
    assert alignment.align(none).count() == 0


def test_large_groups_are_counted_by_id():
    rng = np.random.default_rng(3)
    of_a, of_b = np.array([1, 300, 2, 1]), np.array([2, 400, 1, 1])
    a, b = rng.integers(0, 9, of_a.sum()), rng.integers(0, 7, of_b.sum())
    keys, times = alignment.pair_counts(a, b, of_a, of_b)
    want, at_a, at_b = Counter(), 0, 0
    for n, m in zip(of_a.tolist(), of_b.tolist(), strict=True):
        want.update((x << 20) | y for x in a[at_a : at_a + n].tolist() for y in b[at_b : at_b + m].tolist())
        at_a, at_b = at_a + n, at_b + m
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == dict(want)


@pytest.mark.parametrize("name", ["op11_resampling", "op12_jaccard_join"])
def test_new_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())
    assert found.count() == 200


def test_alignment_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_alignment"](spark, SF).collect()), key=str) == aligned_plainly(rows)
