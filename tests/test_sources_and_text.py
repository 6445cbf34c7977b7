"""Record files, scalar rules and text rules on awkward rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import text as X
from ledgerlens.operators import vision as N
from ledgerlens.sources import records as R


def one(spark, expr, *values):
    """expr over one row whose columns are a, b, ..."""
    names = "abcdef"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*map(F.col, names)).alias("x")).first().x


def test_csv_records(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿Txn_ID,Sender,Beneficiary,AMT,Date,extra\n1, A1 ,B1,10.5,2024-01-02T03:04:05Z,x\n2,A2,,7,2024-01-02 10:00:00,\n3,A3,B3,ten,2024-01-02,\n4,A4,B4,1,never,\n", encoding="utf-8")
    rows = R.read_records(spark, str(path), "transactions")
    good, bad = R.split_bad(rows, "transactions")
    assert [(r.txn_ref, r.from_account, r.amount, r.timestamp) for r in good.collect()] == [("1", "A1", 10.5, datetime(2024, 1, 2, 3, 4, 5))]
    assert sorted(r.reason for r in bad.collect()) == ["no amount", "no timestamp", "no to_account"]
    with pytest.raises(ValueError, match="callee"):
        R.check_required({"caller": "x", "timestamp": "t"}, "call_records", ["x", "t"])


def test_headers_are_taken_once_when_exclusive():
    assert R.resolve_headers(["FROM", "To", "Date"], "call_records") == {"caller": "FROM", "callee": "To", "timestamp": "Date"}
    columns = ["reference", "sender", "beneficiary", "value", "date"]
    assert R.resolve_headers(columns, "transactions", exclusive=True)["txn_ref"] == "reference"


def test_last_owner_wins_and_only_nulls_are_filled(spark):
    rows = spark.createDataFrame([("x", None), ("y", "kept"), ("z", None)], "acc string, owner_name string")
    owners = spark.createDataFrame([("x", "old", 1), ("x", "new", 2), ("y", "other", 1)], "identifier string, owner string, seq int")
    assert {(r.acc, r.owner_name) for r in R.with_owners(rows, owners, "acc", "owner_name").collect()} == {("x", "new"), ("y", "kept"), ("z", None)}


@pytest.mark.parametrize(("text", "want"), [("  Shri  Ram,  Kumar. ", "ram kumar"), ("Mrs. O'Neil", "oneil"), ("Drake", "drake"), ("DR. X", "x")])
def test_names(spark, text, want):
    assert one(spark, S.normalize_name, text) == want


def test_identifiers(spark):
    assert one(spark, S.normalize_identifier, "+91 98765-43210") == "9876543210"
    assert one(spark, S.normalize_identifier, "911234567890") == "1234567890"
    assert one(spark, S.normalize_phone, "09876543210") == "9876543210"
    assert one(spark, S.normalize_account, "ab-12. 3/4") == "AB1234"
    assert one(spark, S.identifier_type, "98765 43210") == "PHONE"
    assert one(spark, S.identifier_type, "58765 43210") == "ACCOUNT"
    assert one(spark, S.identifier_key, "PHONE", "") is None
    assert one(spark, lambda a, b: S.person_key(a, b), "C1", "Smt. Rao, Asha Rao") == "P:C1:asha rao rao"
    assert one(spark, S.nfkc, "ﬁ①") == "fi1"


def test_likeness_by_common_subsequence(spark):
    assert one(spark, S.indel_ratio, "abcd", "abxd") == pytest.approx(75)
    assert one(spark, S.indel_ratio, "", "") == 100
    assert one(spark, S.indel_ratio, "a" * 300, "a" * 299 + "b") == pytest.approx(100 * 2 * 299 / 600)


def test_dates(spark):
    assert one(spark, S.first_date, "on 31/02/2024 or 5.3.2024 or 2024-01-01") == date(2024, 3, 5)
    assert one(spark, S.first_date, "the 12th May, 2026 and 2020-01-01") == date(2026, 5, 12)
    assert one(spark, S.first_date, "nothing") is None
    assert one(spark, S.parse_moment, "2024-01-02T10:00:00Z") == datetime(2024, 1, 2, 10)
    assert one(spark, S.parse_moment, "02/01/2024 05:30") == datetime(2024, 1, 2)
    assert one(spark, S.parse_moment, "soon") is None
    assert one(spark, S.parse_day, "02-01-2024") == datetime(2024, 1, 1, 18, 30)
    assert one(spark, lambda a: S.ist_day(F.to_timestamp(a)), "2024-01-01 18:30:00") == date(2024, 1, 2)
    assert one(spark, lambda a: S.indian_grouping(a.cast("double")), "-1234567.8") == "-12,34,567"
    assert one(spark, lambda a: S.indian_grouping(a.cast("double")), "999") == "999"
    assert one(spark, lambda a: S.score_text(a.cast("double")), "250") == "above 100"
    assert one(spark, S.snippet, "a  b\n" + "c" * 300).endswith("…")


def test_entities_do_not_overlap(spark):
    text = "Asha Rao of Pune called 9876543210 from MH 12 AB 1234 with a country-made pistol; account 123456789012 held heroin."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = X.entities(docs, [("Asha Rao", "PERSON"), ("Rao", "PERSON"), ("Pune", "LOCATION"), ("of", "ORG")]).orderBy("start").collect()
    assert [(r.type, r.surface) for r in found] == [("PERSON", "Asha Rao"), ("LOCATION", "Pune"), ("PHONE", "9876543210"), ("VEHICLE", "MH 12 AB 1234"), ("WEAPON", "country-made pistol"), ("BANK_ACCOUNT", "123456789012"), ("DRUG", "heroin")]
    assert all(text[r.start : r.end] == r.surface for r in found)


def test_relations(spark):
    def rel(a, b, gap, sentence="x"):
        return one(spark, X.relation_type, a, b, gap, sentence)

    assert rel("PERSON", "PHONE", " was contacted on ") == "OWNS"
    assert rel("PERSON", "PERSON", " near ") == "ASSOCIATES_WITH"
    assert rel("PERSON", "PERSON", " paid then called ") == "TRANSACTED_WITH"
    assert rel("PERSON", "LOCATION", " of ") == "LOCATED_AT"
    assert rel("DRUG", "PERSON", " of ") == "ASSOCIATES_WITH"


def test_sentences_end_at_lines(spark):
    docs = spark.createDataFrame([(1, "One. Two!\nThree\n\nFour? Five")], "doc_id long, text string")
    assert [r.sentence for r in X.sentences(docs).orderBy("sentence_no").collect()] == ["One.", "Two!", "Three", "Four?", "Five"]


def test_sentences_keep_their_figures_and_lose_their_blanks(spark):
    docs = spark.createDataFrame([(1, "00 first. 11 call 1 \n\u00a022 pay 2. 3\n \nend\u3000")], "doc_id int, text string")
    assert [r.sentence for r in X.sentences(docs).orderBy("sentence_no").collect()] == ["00 first.", "11 call 1", "22 pay 2.", "3", "end"]


def test_nearest_person_left_first(spark):
    ids = spark.createDataFrame([(1, 20, 30, "id")], "doc_id long, start int, end int, surface string")
    people = spark.createDataFrame([(1, 5, 15, "left"), (1, 35, 40, "right"), (1, 22, 25, "inside")], "doc_id long, start int, end int, surface string")
    assert X.attach(ids, people).first().person == "left"
    assert X.attach(ids, people, 4).count() == 0


def test_clues(spark):
    rows = [(1, 0, "person"), (1, 0, "person"), (1, 0, "backpack"), (1, 1, "car"), (1, 2, "truck"), (2, 0, "person"), (3, 0, "dog"), (3, 0, "knife")]
    found = {(r.run, r.kind, r.severity, r.frames) for r in N.clues(spark.createDataFrame(rows, "run long, frame int, label string"), spark.range(1, 5).withColumnRenamed("id", "run")).collect()}
    assert found == {(1, "group", "medium", 1), (1, "carried_item", "medium", 1), (1, "vehicle", "medium", 2), (2, "presence", "low", 1), (3, "weapon", "high", 1), (4, "none", "low", 0)}
    assert N.sample_index(100, 12) == list(range(0, 96, 8)) and N.sample_index(5, 12) == [0, 1, 2, 3, 4] and N.sample_index(0, 3) == []


def test_fuzzy_resolution_against_plain_greedy(spark):
    """No pair that reaches the threshold is missed, whatever letters it differs in; clusters are the greedy ones."""
    import random

    from ledgerlens.functions import scalars as S
    from ledgerlens.operators import resolution as R

    rng = random.Random(2)
    names = ["Krishnamurthy Venkataraman", "Crishnamurthy Venkataraman", "Venkataraman Krishnamurthy", "Rao", "Roa"]
    for _ in range(60):
        base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(6, 11))) for _ in range(rng.randint(1, 3)))
        names.append(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(base))
            base = base[:at] + rng.choice(["", rng.choice("abcde "), base[at : at + 1] + "x"]) + base[at + 1 :]
            names.append(base.strip() or "z")
    names = sorted(set(names))

    def tokens(n):
        return " ".join(sorted(" ".join(n.lower().split()).split(" ")))

    seeds, want = [], {}
    for n in sorted(names, key=lambda n: (-len(n), n)):
        want[n] = next((x for x in seeds if S._ratio(tokens(x), tokens(n)) >= 95), n)
        if want[n] == n:
            seeds.append(n)
    found = {r.name: r.seed for r in R.resolve_fuzzy(spark.createDataFrame([("P", n) for n in names], "type string, name string")).collect()}
    assert found == want
    assert want["Krishnamurthy Venkataraman"] == want["Venkataraman Krishnamurthy"] == "Crishnamurthy Venkataraman" and len(seeds) < len(names)


def test_headers_bodies_and_nobody(spark):
    from ledgerlens.operators import extraction as T

    texts = ["FIR No. : 12/24\nPolice Station: Colaba\nAccused: A. Rao, unidentified; others and B Das.\nSource Reference: x\n\nBody: here\n", "Weather: fine\nFIR: 1", "Title: only", "no header", "Document: t\r\n\r\nRest"]
    reports = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.field): r.value for r in T.report_headers(reports).collect()}
    assert found == {(0, "fir"): "12/24", (0, "station"): "Colaba", (0, "accused"): "A. Rao, unidentified; others and B Das.", (0, "source_reference"): "x", (2, "title"): "only", (4, "title"): "t"}
    assert {r.name for r in T.accused(T.report_headers(reports)).collect()} == {"A. Rao", "B Das"}
    bodies = {r.doc_id: (r.body, r.body_start) for r in T.report_bodies(reports).collect()}
    assert [bodies[i][0] for i in range(5)] == ["Body: here\n", texts[1], "", texts[3], "Rest"]
    assert all(texts[i][b:] == t for i, (t, b) in bodies.items())


def test_dates_need_whole_months_and_names_compatibility_form(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions import scalars as S

    row = spark.range(1).select(
        S.first_date(F.lit("12 marching 2026 then 3rd Sept. 2026")).cast("string").alias("day"), S.person_key(F.lit("K-1"), F.lit("Mr. \uff32ao (O'Brien) rao,")).alias("key"),
        S.person_key(F.lit("bad case"), F.lit("Rao")).alias("none"), S.case_of(F.lit("P:K-1:das rao")).alias("case"), S.name_of(F.lit("P:K-1:das rao")).alias("name"),
    ).first()
    assert (row.key, row.none, row.case, row["name"]) == ("P:K-1:o'brien rao rao", None, "K-1", "das rao")
    assert row.day == "2026-09-03"


def test_spans_lie_in_their_sentence_and_overlaps_go(spark):
    """in_sentences against all pairs, over the documents; entities never overlap and keep their surfaces."""
    from ledgerlens.operators import text as X

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, "Call 9876543210 now. He had heroin,\nand a pistol! Then 9876543211."), (9002, "9876543210")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = X.entities(docs).collect()
    sentences = X.sentence_spans(docs).collect()
    by_doc = {}
    for s in sentences:
        by_doc.setdefault(s.doc_id, []).append((s.s_start, s.s_end, s.sentence_no))
    assert {(r.doc_id, r.start, r.end): r.surface for r in spans} == {(r.doc_id, r.start, r.end): texts[r.doc_id][r.start : r.end] for r in spans}
    for i in {r.doc_id for r in spans}:
        own = sorted((r.start, r.end) for r in spans if r.doc_id == i)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
    want = set()
    for r in spans:
        held = [n for a, b, n in by_doc.get(r.doc_id, []) if a <= r.start and r.end <= b]
        if held:
            want.add((r.doc_id, r.start, r.end, r.type, r.surface, min(held)))
    found = X.in_sentences(X.entities(docs), X.sentence_spans(docs)).select("doc_id", "start", "end", "type", "surface", "sentence_no").collect()
    assert {tuple(r) for r in found} == want and sum(r[0] == 9001 for r in want) == 4


def test_near_verbatim_lineage_against_all_pairs(spark):
    from ledgerlens.functions import scalars as S
    from ledgerlens.plans import QUERIES

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    words = {p.p_partkey: (p.p_brand + p.p_name[:1], " ".join((p.p_name + " " + p.p_type).lower().split())) for p in parts}
    want = {(b, a): round(S._ratio(words[a][1], words[b][1]), 4) for a in words for b in words if a < b and words[a][0] == words[b][0] and S._ratio(words[a][1], words[b][1]) >= 85}
    found = {(r.derivative, r.origin): r.score for r in QUERIES["lineage_near_verbatim"](spark, "/root/testdata/sf0.001").collect()}
    assert found == want


def test_first_bare_words_and_names_of_two_words(spark):
    texts = ["", "one", " lead two", "a,  (b) c d", "x\ty ", " p q r", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(X.bare_words(F.col("text")).alias("all"), X.bare_words(F.col("text"), 2).alias("first")).collect()
    assert all(r.first == (None if r.all is None else r.all[:2]) for r in rows)
    names = spark.createDataFrame([("a b",), ("one",), ("c d",), ("b c d",)], "surface string")
    found = lambda **k: sorted((r.doc_id, r.place, r.surface) for r in X.gazetteer_hits(docs, names, 2, **k).collect())
    assert found(fewest=2) == [(3, 0, "a b"), (3, 2, "c d")] == [x for x in found() if " " in x[2]]
    assert (1, 0, "one") in found()


def test_claims_take_the_mentions_once(spark):
    from ledgerlens.operators import extraction, text

    bodies = spark.createDataFrame([(1, "C1", "Asha Rao called his associate Ravi Das. Number 6000000001 is with Asha Rao.", None)], "doc_id long, case_code string, body string, document_day date")
    found = extraction.claims(bodies, text.entities(bodies.selectExpr("doc_id", "body AS text"), [("Asha Rao", "PERSON"), ("Ravi Das", "PERSON")]))
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.predicate, r.sentence_no, r.object) for r in found.collect())[0] == ("HOLDS", 1, "PHONE:6000000001")
