"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import chunkdedup, common, decontam, linededup, neardocs, packing, quality, queries, sharding, simhash, toxicity, urlfilter, winnowing

SF = "/root/testdata/sf0.001"
#: Clashing names: every operator must read its own columns only.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, line string, fp string, label string, bucket string, part string, key string"


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "of", "er", "on", "and", "tion", "ha", "es", "é", "st", "ing", "re", "Ou", "th", "a"]
    out = []
    for i in range(words):
        out.append("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + ("." if i % 9 == 8 else ""))
        if i % 20 == 19:
            out[-1] += "\n"
    return " ".join(out)


def awkward_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (103, "A"), (104, prose(rng, 9000)), (105, "x" * 5000), (106, "Ünïcode 日本語 \U0001f600 İΣ"), (None, "no id here at all"), (107, "<|endoftext|> in text")]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (200, rows[4][1]), (201, rows[4][1].upper()), (202, rows[5][1] + " extra")]
    rows += [(300 + i, rows[6][1]) for i in range(6)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", None if n % 7 == 0 else f"s{n % 3}", 1, "r", "l", "f", "b", "k", "p", "y") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "src long, dst long"), "t").collect()}
    want = roots_of({n for e in edges for n in e}, edges)
    assert found == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "src long, dst long"), "t").count() == 0


# 3: SimHash


def simhash_plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(docs, rows, none):
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in found) == sorted((i is None, i or 0, f"{simhash_plain(t):016x}") for i, t in rows)
    prints = {(i, simhash_plain(t)) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if (a[1] ^ b[1]).bit_count() <= 2]
    groups = defaultdict(set)
    for n, r in roots_of(sorted(prints, key=str), [tuple(sorted(x, key=str)) for x in links]).items():
        groups[r].add(n)
    least = {n: min((x[0] for x in g if x[0] is not None), default=None) for g in groups.values() for n in g}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{p:016x}", least[i, p]) for i, p in prints}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # One row of each component, whatever its id: groups hold (id, fingerprint) pairs.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min((x[0] for x in g if x[0] is not None), default=None)) for g in groups.values())


@pytest.mark.parametrize("keep_one", [simhash.keep_one, neardocs.keep_one])
def test_one_row_of_each_group_stays(spark, keep_one):
    rng = random.Random(31)
    texts = [prose(rng, 60) for _ in range(4)]
    rows = [(2, texts[0], "a"), (2, texts[0], "b"), (None, texts[0], "c"), (None, texts[1], "d"), (None, texts[1], "d"), (7, texts[2], "e"), (7, texts[3], "f"), (5, texts[2], "g"), (None, None, "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = [(r.doc_id, r.text) for r in keep_one(frame).collect()]
    assert sorted(kept, key=str) == sorted([(2, texts[0]), (None, texts[1]), (5, texts[2]), (7, texts[3]), (None, None)], key=str)
    assert keep_one(frame.where("false")).count() == 0


@pytest.mark.parametrize("segments", [8, 16, 32])
def test_grid_join_finds_every_close_pair(spark, segments):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base[:20]:  # chains and crowds around the same fingerprint
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << bit
            prints.add(x)
    signed = {p: simhash._signed(p) for p in prints}
    distinct = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = simhash.links(distinct, segments).collect()
    assert all(((r.src ^ r.dst) & ((1 << 64) - 1)).bit_count() <= 2 for r in links)
    nodes = list(signed.values())
    want = roots_of(nodes, [(a, b) for a in nodes for b in nodes if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2])
    assert roots_of(nodes, [(r.src, r.dst) for r in links]) == want


# 4: packing


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    found = packing.pack(docs, group_documents=20).collect()
    want = []
    for i, x in ids:
        for start in range(0, len(x), 2048):
            part = np.array(x[start : start + 2048], "<u4").tobytes()
            want.append((str(i), start, len(part) // 4, zlib.crc32(part), len(x)))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_encoder_equals_tokenizer_on_odd_words():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(3)
    letters = "aAzZ'sStT019.,!?-_ \n\t\r\x0b\x0céÉßÿÀ×÷%$#<|>~\"ll're"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_vocabularies_are_read_by_their_own_tokenizer(spark, docs, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.pieces(docs, vocabulary=path).where("start = 0").collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in found) == sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert len({r.token for r in found}) == len(rows)  # repeated rows are drawn apart


def test_first_fit_decreasing_against_plain_first_fit():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    rooms, want = [], []
    for need in lengths:
        at = next((i for i, r in enumerate(rooms) if r >= need), len(rooms))
        if at == len(rooms):
            rooms.append(100)
        want.append((at, 100 - rooms[at]))
        rooms[at] -= need
    assert packing.first_fit_decreasing(lengths, 100) == want


# 5: lines


def test_line_dedup_against_all_pairs(spark, rows, none):
    rng = random.Random(9)
    lines = [prose(rng, 15).replace("\n", "") for _ in range(12)]
    near = [lines[0][:-1] + "q", lines[1] + " x", "  " + lines[2].upper(), lines[3].replace(" ", "  ", 1)]
    texts = [(i, "\n".join(rng.sample(lines + near, 5) + [""])) for i in range(12)] + [(50, None), (51, ""), (52, "ab\nab\nAB "), (None, lines[0]), (53, lines[5]), (53, lines[5])]
    frame = spark.createDataFrame([(i, t, 7, "x") for i, t in texts], "doc_id long, text string, n_lines int, row string")
    found = linededup.deduplicate_lines(frame).collect()

    def form(line):
        return " ".join(re.findall(r"[^ \t\n\r\x0b\x0c]+", line)).lower()

    def grams(f):
        return {f[i : i + 5] for i in range(max(1, len(f) - 4))}

    forms = sorted({form(x) for _, t in texts if t is not None for x in t.split("\n")} - {""})
    sets = {f: grams(f) for f in forms}
    root = roots_of(forms, [(a, b) for a in forms for b in forms if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9])
    keys = {(i, t): frame.where(f"doc_id {'is null' if i is None else '= ' + str(i)}").select(*common.row_keys()).first() for i, t in texts}
    first = {}
    for i, t in texts:
        for n, x in enumerate((t or "").split("\n")):
            if form(x):
                at = (i is None, i or 0, *keys[i, t], n)
                first[root[form(x)]] = min(first.get(root[form(x)], at), at)
    want = []
    for i, t in texts:
        kept = t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not form(x) or first[root[form(x)]] == (i is None, i or 0, *keys[i, t], n))
        want.append((str(i), str(kept), 0 if t is None else t.count("\n") + 1))
    assert sorted((str(r.doc_id), str(r.text), r.n_lines) for r in found) == sorted(want)
    assert linededup.deduplicate_lines(none).count() == 0


def test_crowded_bands_keep_all_connections(spark):
    """More near lines than centres, in a chain whose ends are unlike each other."""
    rng = random.Random(4)
    line = [rng.choice("abcdefghij") for _ in range(120)]
    chain = []
    for i in range(40):
        line[3 * i % 120] = rng.choice("klmnop")
        chain.append("".join(line))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    found = linededup.deduplicate_lines(frame)
    assert [r.doc_id for r in found.where("n_removed = 0").collect()] == [0]


def test_band_keys_do_not_depend_on_neighbours():
    lines = ["short", "ab", "a much longer line of words for the test", "é" * 40, "ab" * 300]
    together, bits = linededup.line_keys(lines)
    for i, x in enumerate(lines):
        keys, own = linededup.line_keys([x])
        assert (keys[0] == together[i]).all() and own[0] == bits[i]


@pytest.mark.parametrize("size", [4, 8, 12, 20, 40, 120, 600])
def test_similar_lines_meet_as_stated(size):
    """Pairs of lines of which one has size shingles and the other a quarter more: Jaccard 0.8, where 0.981 should meet."""
    rng = random.Random(size)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size + 4)) for _ in range(2000)]
    longer = [x + "".join(rng.choice("abcdefghij") for _ in range(size // 4)) for x in lines]
    (keys, bits), (others, more) = linededup.line_keys(lines), linededup.line_keys(longer)
    met = (keys == others).any(axis=1)
    assert met.mean() > 0.965
    # The agreement bits rule none of them out, and nearly all unlike pairs.
    differ = np.array([int(x).bit_count() for x in (bits ^ more).view(np.uint64)])
    apart = np.array([int(x).bit_count() for x in (bits ^ np.roll(more, 1)).view(np.uint64)])
    assert (differ <= linededup._most_bits(0.8)).all() and (apart > linededup._most_bits(0.8)).mean() > 0.99


def test_keys_of_several_lines_are_found_by_sorted_runs(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SORTED_KEYS", 64)
    rng = np.random.default_rng(3)
    # Small keys as the first of ordered hashes, negative ones, one key of all lines, repeats within a line.
    rows = [(int(line), [7, 7, *rng.integers(-400, 400, 5).tolist()]) for line in rng.permutation(200) - 100] + [(5000, []), (5001, [10**12])]
    lines = spark.createDataFrame(rows, "line long, keys array<long>").repartition(3)
    found = linededup.several(lines, "keys", sum(len(k) for _, k in rows))
    owners = {k: {line for line, keys in rows if k in keys} for _, keys in rows for k in keys}
    keys = np.array(list(owners), np.int64)
    assert linededup.in_bitmap(found, keys.view(np.uint64)).tolist() == [len(owners[k]) > 1 for k in keys.tolist()]


def test_lines_are_cut_without_python(spark):
    docs = spark.createDataFrame([(1, "same line here\n\nown one"), (2, "x yz\nsame line here\nsame line here\n"), (3, "same line here"), (4, None), (5, "")], "doc_id long, text string")
    out = linededup.deduplicate_lines(docs)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "same line here\n\nown one", 3, 0), (2, "x yz\n", 4, 2), (3, "", 1, 1), (4, None, 0, 0), (5, "", 1, 0)]


def test_one_document_of_many_lines(spark):
    """A document of 200 000 short lines, most of them repeats, is cut in time linear in its lines."""
    text = "\n".join(str(i % 1000 * 7919) for i in range(200_000))
    found = linededup.deduplicate_lines(spark.createDataFrame([(1, text), (2, text + "\n")], "doc_id long, text string")).collect()
    kept = {r.doc_id: r.text.split("\n") for r in found}
    forms = [str(i * 7919) for i in range(1000)]
    assert set(kept[1]) <= set(forms) and len(kept[1]) == len(set(kept[1])) and kept[2] == [""]


# 7: shards


def test_shards_hold_the_law_and_the_mixture(spark, docs, rows, none):
    found = sharding.shard(docs, shards=7).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(none).count() == 0
    big = spark.range(9000).selectExpr("id doc_id", "'t' text", "case when id % 3 = 0 then 'hot' when id % 100 = 1 then null else concat('s', id % 5) end source")
    shards = sharding.shard(big).groupBy("shard", "source").count().collect()
    whole = defaultdict(int)
    for r in shards:
        whole[r.source] += r["count"]
    assert all(abs(r["count"] - whole[r.source] / 40) < 2.01 for r in shards)


# 8: benchmark


def decontam_plain(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, named = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        for p in {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else ():
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) == p:
                    hit |= set(range(i, i + size))
                    named.add(str(item))
    return len(own), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 150])
def test_decontamination_against_brute_force(spark, docs, rows, none, block):
    long = rows[44][1].split()
    items = [(1, " ".join(long[50:75])), (2, " ".join(long[60:90]).upper()), (10, "No, ID!"), (3, "a"), (4, None), (5, "!!"), (None, "x"), (6, rows[0][1]), (7, " ".join(long[70:79]))]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, row string")
    found = decontam.find(docs, bench, block_bytes=block).collect()
    good = [(i, t) for i, t in items if i is not None and t is not None]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == sorted((str(i), *decontam_plain(t, good)) for i, t in rows)
    assert decontam.find(none, bench).count() == 0
    assert decontam.find(docs, bench.where("false")).where("contaminated").count() == 0


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 150])
def test_contaminated_rows_go_whatever_their_id(spark, block):
    rng = random.Random(30)
    leak, items = " ".join(prose(rng, 30).split()), []
    items = [(1, leak), *((10 + i, prose(rng, 25)) for i in range(4))]
    rows = [(1, leak + " more"), (1, "clean words"), (None, "and " + leak), (None, "clean too"), (4, None), (5, ""), (6, "x " + leak), (6, "x " + leak)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, items int")
    left = decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert left.columns == frame.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect() if r.text) == [("1", "clean words"), ("None", "clean too")]
    assert left.count() == 4


def test_wu_manber_on_repetitive_words():
    rng = random.Random(8)
    for _ in range(200):
        items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))) for i in range(4)]
        text = " ".join(rng.choice("abc") for _ in range(30))
        machines = decontam.searchers([(i, t.encode()) for i, t in items], 3)
        spans, named = decontam._hits(decontam.words_of(text.encode()), machines)
        assert (sum(b - a for a, b in spans), len(named)) == decontam_plain(text, items, 3)[1:3]


# 9: winnowing


def winnow_plain(text, k=winnowing.K, w=winnowing.WINDOW):
    if not text:
        return []
    points = winnowing.code_points(text)
    k = min(k, len(points))
    hashes = [int(winnowing.gram_hashes(points[i : i + k], k)[0]) for i in range(len(points) - k + 1)]
    w, out = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


def test_winnowing_against_brute_force(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(winnowing, "RUN_DOCUMENTS", 7)
    # An id that fills runs alone, and rows without ids.
    more = [(150, f"copy {i}") for i in range(40)] + [(None, f"none {i}") for i in range(20)]
    every = rows + more
    whole = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    keys = {(r.doc_id, r.text): (r.row, r.row2) for r in whole.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *common.row_keys()).collect()}
    found = winnowing.edit_likeness(whole).collect()
    order = sorted(((i is not None, i or 0, keys[i, t or ""], t or "") for i, t in every), reverse=True)
    want = []
    for (has, i, _, t), (_, _, _, n) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        prints = [winnow_plain(x) for x in (t, e, n)]
        a, b, c = ({h for h, _ in p} for p in prints)
        like = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        want.append((str(i) if has else "None", len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{h:08x}" for h, _ in prints[0]), "".join(f"{h:08x}" for h, _ in prints[1]), *like))
    assert sorted(map(tuple, ((str(r.doc_id), *r[1:]) for r in found))) == sorted(want)
    assert winnowing.edit_likeness(none).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert winnowing.edit_likeness(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_shared_passages_share_a_fingerprint():
    rng = random.Random(6)
    for _ in range(50):
        passage = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.WINDOW + winnowing.K - 1))
        sides = ["".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 80))) + passage + "".join(rng.choice("qrstu ") for _ in range(50)) for _ in range(2)]
        a, b = (set(winnowing.winnow(winnowing.code_points(s))[0].tolist()) for s in sides)
        assert a & b


# 10: chunks


def test_chunks_rebuild_texts_and_resist_insertions():
    gear = chunkdedup.gear_table()
    rng = random.Random(7)
    data = prose(rng, 2000).encode()

    def parts(x):
        ends = chunkdedup.cut_points(x, gear)
        return [x[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    assert b"".join(parts(data)) == data and all(chunkdedup.LEAST_BYTES <= len(p) <= chunkdedup.MOST_BYTES for p in parts(data)[:-1])
    h, plain = 0, []
    for b in data[:500]:
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        plain.append(h & chunkdedup.CUT_MASK == 0)
    last = 0
    want = [last := i + 1 for i, c in enumerate(plain) if c and i + 1 - last >= chunkdedup.LEAST_BYTES]
    got = [e for e in chunkdedup.cut_points(data, gear) if e <= 500]
    assert got[: len(want)] == want
    changed = data[:3000] + b"inserted" + data[3000:]
    assert len(set(parts(changed)) - set(parts(data))) <= 6
    assert parts(b"") == []


def test_repeated_passages_are_found_and_others_left(spark, docs, rows, none):
    rng = random.Random(12)
    passage = prose(rng, 60).replace("\n", "")
    texts = [(i, prose(rng, 80) + (passage if i % 5 == 0 else "") + prose(rng, 30)) for i in range(30)] + [(90, None), (91, "")]
    found = chunkdedup.repeats(spark.createDataFrame([(i, t, "d") for i, t in texts], "doc_id long, text string, digest string")).collect()
    assert {r.doc_id for r in found} == {0, 5, 10, 15, 20, 25}
    assert all((r.removable == 0) == (r.doc_id == 0) for r in found)
    for r in found:
        text = dict(texts)[r.doc_id].encode()
        assert sum(x.encode().count(text[r.start : r.start + r.length]) for _, x in texts if x) >= 2
    assert chunkdedup.repeats(none).count() == 0

    everything = chunkdedup.repeats(docs).collect()
    gear, places = chunkdedup.gear_table(), defaultdict(set)
    for i, t in rows:
        ends = chunkdedup.cut_points((t or "").encode(), gear)
        for a, b in zip([0, *ends], ends, strict=False):
            places[(t or "").encode()[a:b]].add((i, t, a))
    chunks = defaultdict(dict)
    for data, at in places.items():
        if len(at) > 1:
            for i, t, a in at:
                chunks[i, t][a] = a + len(data)
    want = []
    for (i, _), own in chunks.items():
        for a in sorted(own):
            if want and want[-1][0] == i and want[-1][2] == a and want[-1][3] is own:
                want[-1][2] = own[a]
            else:
                want.append([i, a, own[a], own])
    assert sorted((str(r.doc_id), r.start, r.length) for r in everything) == sorted((str(i), a, b - a) for i, a, b, _ in want if b - a >= chunkdedup.SPAN_BYTES)


# 1 and 2: classifiers


def test_train_pieces_come_from_the_whole_text():
    text = bytes(i // 1000 % 256 for i in range(100_000))
    pieces = quality.train_pieces(text)
    assert len(pieces) == quality.TRAIN_PIECES and pieces[0] == text[:1000] and pieces[-1] == text[-1000:]
    assert b"".join(quality.train_pieces(text[:7500])) == text[:7500]


def test_quality_without_a_second_class_scores_the_share(spark):
    docs, labels = labelled(spark, lambda rng, t: t)
    assert {r.score for r in quality.quality(docs, labels.withColumn("quality", F.lit(1))).collect()} == {0.99}


def labelled(spark, bad, n=240):
    rng = random.Random(13)
    texts, labels = [], []
    for i in range(n):
        mark = i % 3 == 0
        texts.append((i, bad(rng, prose(rng, 60)) if mark else prose(rng, 60), "z"))
        labels.append((i, 0 if mark else 1, 1 if mark else 0, "t"))
    texts += [(900, None, "z"), (901, "", "z"), (902, "ab", "z"), (0, texts[0][1], "z")]
    return spark.createDataFrame(texts, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("op", "column", "folds", "out", "bad"), [
    (toxicity.toxicity, "toxic", 5, 0, lambda rng, t: t[:80] + " zgrubnik " + t[80:]),
    (quality.quality, "quality", 3, 1, lambda rng, t: t.upper().replace(" ", "!! ")),
])
def test_classifiers_on_held_out_rows(spark, op, column, folds, out, bad):
    docs, labels = labelled(spark, bad)
    found = op(docs, labels).collect()
    assert len(found) == docs.count()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # Labels of held-out rows have no say.
    turned = labels.withColumn(column, (1 - labels[column]).cast("int")).where(common.fold_of(labels.doc_id, folds) == out).unionByName(labels.where(common.fold_of(labels.doc_id, folds) != out))
    again = {(r.doc_id, r.score) for r in op(docs, turned).collect()}
    assert again == {(r.doc_id, r.score) for r in found}
    assert op(docs.where("false"), labels).count() == 0
    assert op(docs, labels.where("false")).count() == docs.count()


def test_rejected_documents_go(spark):
    docs, labels = labelled(spark, lambda rng, t: t.upper().replace(" ", "!! "))
    kept = quality.keep_good(docs, labels)
    scores = {(r.doc_id, r.predicted) for r in quality.quality(docs, labels).collect()}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores if p == 1}


# 6: URLs


def judged_plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_url_rules_and_trees(spark):
    rng = random.Random(14)
    urls = [None, "", "no scheme", "http://", "http://COM/x", "http://a.com", "http://EXAMPLE.com/en/1", "https://www.example.com/en/2?q=1#f", "x://blog.www.example.com/en/", "http://a.net/es/1", "http://a.net/fr/", "http://net/fr/q", "http://notnet/fr/", "http://é.ORG:80/p//q", "a://b://c.com/", "http://u@h.com?x/y"]
    urls += [f"http://s{rng.randint(0, 9)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randint(0, 999)}" for _ in range(200)] + ["http://a.net/es/1"] * 3
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, label int")
    found = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = judged_plain(u)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule), u
        assert found[i].verdict == verdict if verdict else found[i].verdict in ("allow", "block")
        assert (found[i].score is None) == (verdict is not None)
    assert urlfilter.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages.where("url like '%org%'")).collect()} == {"allow"}


def test_trees_on_held_out_urls(spark):
    """Trees fitted to half of URLs whose class is in their lexical features judge the other half; no label is among its own features."""
    rng = random.Random(15)
    urls = []
    for i in range(800):
        bad = i % 2
        path = "".join(rng.choice("0123456789") for _ in range(20)) if bad else "/".join(rng.choice(["news", "story", "about", "team"]) for _ in range(3))
        urls.append((i, f"http://h{rng.randint(0, 30)}.org/{path}" + ("?a=1&b=2" if bad else "")))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = (("block", "org", "/0"), ("block", "org", "/1"), ("block", "org", "/2"), ("block", "org", "/3"), ("block", "org", "/4"), ("allow", "org", "/news"), ("allow", "org", "/about"))
    found = urlfilter.judge(pages, rules).where("rule is null").collect()
    assert 200 < len(found) and np.mean([(r.verdict == "block") == bool(r.page_id % 2) for r in found]) > 0.95


def test_suffix_statistics_leave_the_own_fold_out(spark):
    pages = spark.createDataFrame([(i, f"http://only{i}.com/x") for i in range(40)] + [(100 + i, "http://a.net/es/") for i in range(30)] + [(200, "http://q.net/")], "page_id long, url string")
    rows = {r.page_id: r for r in urlfilter.features(pages).collect()}
    # A site with one labelled URL, and one whose URLs are all in one fold, know no label but the overall share.
    share = 30 / 70
    assert all(abs(rows[i].site_share - share) < 1e-9 for i in [*range(40), *range(100, 130)])
    assert abs(rows[200].suffix_share - (30 + 20 * share) / 50) < 1e-9


# queries and pipeline


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity", "op2_quality", "op3_simhash", "op5_line_dedup", "op7_sharding", "op8_decontamination", "op9_winnowing"):
        assert queries.QUERIES[name](spark, SF).count() == n, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = {r.doc_id for r in out.collect()}
        assert now <= seen and now
        docs, seen = out, now
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.find(docs, bench).where("contaminated").count() == 0
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == seen


def test_pipeline_drops_planted_near_copies(spark):
    """Copies at five-word Jaccard of 0.8 to 0.9 go, unlike texts stay; against exact likeness of all pairs."""
    import corpus_pipeline

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rng = random.Random(21)
    texts = {}
    for i in range(120):
        words = prose(rng, 300).split()
        texts[i] = " ".join(words)
        for at in rng.sample(range(0, 300, 10), 3 + i % 5):
            words[at] = f"edit{at}"
        texts[1000 + i] = " ".join(words)
    sets = {i: grams(t) for i, t in texts.items()}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i for i, r in roots_of(texts, close).items() if i == r}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.single_documents(spark, docs, SF).collect()}
    assert len(close) > 80 and set(range(120)) <= kept
    assert len(kept - want) <= 0.02 * len(close)


INTERNAL = ["row", "row2", "_row", "_row2", "__row", "removed", "_removed", "ROW2", "stays", "n", "line", "marks"]


@pytest.mark.parametrize("op", [linededup.deduplicate_lines, linededup.cut_documents, neardocs.keep_one, simhash.keep_one])
def test_columns_named_like_internal_ones_stay_as_they_are(spark, op):
    names = [x for x in INTERNAL if x != "ROW2"]
    rng = random.Random(40)
    texts = [prose(rng, 60) for _ in range(3)]
    rows = [(i, t, *(f"{name}-{i}" for name in names)) for i, t in enumerate([*texts, texts[0], None, ""])]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'`{c}` string' for c in names)}")
    out = op(frame)
    assert out.columns[: len(frame.columns)] == frame.columns
    kept = out.collect()
    assert kept and all(r[name] == f"{name}-{r.doc_id}" for r in kept for name in names)


def test_free_names():
    class Rows:
        columns = ["a", "_A", "b.c"]

    assert common.free_names(Rows, "a", "b") == ["__a", "b"]
