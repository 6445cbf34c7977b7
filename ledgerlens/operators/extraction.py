"""Statements from record rows and report headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.storage import stored
from . import text as X

# Fixed values.
HEADER_FIELDS = {
    "fir no": "fir", "fir": "fir", "police station": "station", "station": "station", "date": "date", "accused": "accused",
    "reference": "reference", "source reference": "source_reference", "title": "title", "document": "title",
}
NOBODY = ("unknown", "unidentified", "others", "nil", "none", "n/a")
#: 'Key: value' of a report's first lines.
HEADER_LINE = r"^\s*([A-Za-z][A-Za-z .]{0,40}?)\s*:\s*(.+?)\s*$"
LINK_BEFORE = (
    r"(?i)(in touch with|in contact with|coordinating with|working with|worked for|works for|collected dues for|on (?:the )?instructions of|on behalf of|handed (?:them |her )?over to|"
    r"met|meeting|called|phoned|contacted|paid|remitted|transferred|associate|accomplice|partner|denied knowing|does not know|did not know|never met|never spoke to)"
    r"\s+(?:(?:his|her|their|the|one|a|an)\s+)?(?:(?:associate|accomplice|partner)\s+)?$"
)
PAIR_JOIN = r"(?i)^\s*(?:and|&)\s*$"
LINK_AFTER = r"(?i)^\s+(met|were seen together|spoke|were in touch)\b"


def contact_statements(calls: DataFrame) -> DataFrame:
    """Call rows (row_id, caller, callee, timestamp, duration_sec) as CONTACT statements; rows without an instant state nothing."""
    phone = lambda c: S.identifier_key(F.lit("PHONE"), F.col(c))
    detail = F.when(F.col("duration_sec").isNotNull(), F.concat(F.col("duration_sec").cast("long").cast("string"), F.lit("s")))
    out = calls.select("row_id", F.lit("CONTACT").alias("predicate"), phone("caller").alias("subject"), phone("callee").alias("object"), F.col("timestamp").alias("starts"), detail.alias("detail"))
    return out.where("subject is not null and object is not null and starts is not null")


def transfer_statements(txn: DataFrame) -> DataFrame:
    """Transfer rows (row_id, from_account, to_account, amount text, timestamp) as TRANSFER statements."""
    account = lambda c: S.identifier_key(F.lit("ACCOUNT"), F.col(c))
    amount = F.expr("try_cast(regexp_replace(amount, ',', '') as double)")
    out = txn.select("row_id", F.lit("TRANSFER").alias("predicate"), account("from_account").alias("subject"), account("to_account").alias("object"), F.col("timestamp").alias("starts"), amount.alias("amount"))
    return out.where("subject is not null and object is not null and starts is not null")


def holding_statements(subscribers: DataFrame) -> DataFrame:
    """Subscriber rows as HOLDS statements: one for the identifier, one for a registered mobile.

    subscribers: row_id, case_code, owner_name, identifier, identifier_type,
    valid_from, valid_to (dates, valid_to inclusive), registered_mobile.  Periods that
    end before they start state nothing.
    """
    kind = F.when(F.upper("identifier_type").isin("PHONE", "MOBILE"), "PHONE").when(F.col("identifier_type").isNotNull(), "ACCOUNT").otherwise(S.identifier_type(F.col("identifier")))
    held = F.array(
        F.struct(F.lit(0).alias("ordinal"), S.identifier_key(kind, F.col("identifier")).alias("object")),
        F.struct(F.lit(1).alias("ordinal"), S.identifier_key(F.lit("PHONE"), F.col("registered_mobile")).alias("object")),
    )
    rows = subscribers.select(
        "row_id", S.person_key(F.col("case_code"), F.col("owner_name")).alias("subject"), F.col("valid_from").cast("date").alias("starts"), F.date_add(F.col("valid_to").cast("date"), 1).alias("ends"), F.explode(held).alias("h"),
    )
    out = rows.select("row_id", F.lit("HOLDS").alias("predicate"), "subject", "h.ordinal", "h.object", "starts", "ends")
    return out.where("subject is not null and object is not null and (starts is null or ends is null or starts < ends)")


def statement_keys(statements: DataFrame, artifact: Column, locator: Column) -> DataFrame:
    """statements with key a-<16 hex digits> of case, artifact, locator and the ordinal within the locator."""
    w = Window.partitionBy("_artifact", "_locator").orderBy("ordinal")
    rows = statements.withColumns({"_artifact": artifact, "_locator": locator})
    number = F.row_number().over(w) - 1
    rows = rows.withColumn("_n", number)
    key = F.concat(F.lit("a-"), S.short_hash(16, F.col("case_code"), F.col("_artifact"), F.col("_locator"), F.col("_n").cast("string")))
    return rows.withColumn("key", key).drop("_artifact", "_locator", "_n")


def _field(line: Column) -> Column:
    """The canonical field of a header line, null for any other line."""
    key = F.regexp_replace(F.lower(F.trim(F.regexp_extract(line, HEADER_LINE, 1))), r"\.+$", "")
    # Looked up, so that the patterns are tried once a line and not once a key.
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in HEADER_FIELDS.items() for x in pair)), key)


def _header_size(lines: Column) -> Column:
    """How many lines of a report are its header: up to the first that is blank or no header line."""
    first = F.array_position(F.transform(lines, lambda x: _field(x).isNull()), True)
    return F.when(first > 0, first - 1).otherwise(F.size(lines)).cast("int")


def report_headers(reports: DataFrame) -> DataFrame:
    """(doc_id, n, field, value) of the leading 'Key: value' lines of reports (doc_id, text), up to a blank line or an unknown key."""
    lines = F.split("text", r"\r?\n")
    head = F.slice(lines, F.lit(1), _header_size(lines))
    rows = reports.select("doc_id", F.posexplode(head).alias("n", "line"))
    return rows.select("doc_id", "n", _field(F.col("line")).alias("field"), F.regexp_extract("line", HEADER_LINE, 2).alias("value"))


def report_bodies(reports: DataFrame) -> DataFrame:
    """(doc_id, body, body_start): what follows the header and its blank line, and where in the text it begins."""
    lines = F.split("text", "\n")
    size = _header_size(F.transform(lines, lambda x: F.regexp_replace(x, "\r$", "")))
    rows = reports.select("doc_id", "text", lines.alias("lines"), size.alias("size"))
    blank = (F.col("size") < F.size("lines")) & (F.trim(F.regexp_replace(F.get("lines", F.col("size")), r"\s", "")) == "")
    whole = F.col("size") + F.when(blank, 1).otherwise(0)
    start = F.aggregate(F.slice("lines", F.lit(1), whole), F.lit(0), lambda n, x: n + F.length(x) + 1)
    return rows.select("doc_id", "text", F.least(start, F.length("text")).alias("body_start")).select("doc_id", F.expr("substring(text, body_start + 1)").alias("body"), "body_start")


def accused(headers: DataFrame) -> DataFrame:
    """(doc_id, name) of the accused lines, cut at commas, semicolons and 'and'; nobody's names go."""
    parts = F.split("value", r",|;|\band\b")
    names = headers.where("field = 'accused'").select("doc_id", F.explode(parts).alias("name")).select("doc_id", F.regexp_replace("name", r"^[ .]+|[ .]+$", "").alias("name"))
    return names.where((F.col("name") != "") & ~F.lower("name").isin(*NOBODY) & (F.size(S.name_tokens(F.col("name"))) > 0))


def claims(bodies: DataFrame, mentions: DataFrame) -> DataFrame:
    """What reports state: HOLDS of a number by the person next to it, LINK of two people that a sentence joins.

    bodies: doc_id, case_code, body, document_day.  mentions: doc_id, type, start,
    end, surface within the body; PERSON, PHONE and BANK_ACCOUNT count.  Returns
    (doc_id, sentence_no, predicate, subject, object, day, polarity, detail): a
    sentence with a denial states with polarity -1; a HOLDS without a date of its own
    has the document's.  Two people are linked once a sentence, by their first cue.
    bodies are read several times, mentions once.
    """
    pieces = stored(X.sentence_spans(bodies.select("doc_id", F.col("body").alias("text"))), "claims-sentences")
    found = stored(X.in_sentences(mentions.select("doc_id", "start", "end", "type", "surface"), pieces), "claims-mentions")
    people = found.where("type = 'PERSON'").where(F.size(S.name_tokens(F.col("surface"))) > 0)
    numbers = found.where("type in ('PHONE', 'BANK_ACCOUNT')")
    place = F.struct("doc_id", "sentence_no").alias("doc_id")
    spans = pieces.join(bodies, "doc_id")
    sentence = F.expr("substring(body, s_start + 1, s_end - s_start)")
    told = spans.select("doc_id", "sentence_no", "case_code", "body", "document_day", "s_end", S.first_date(sentence).alias("stated"), F.when(sentence.rlike(X.NEGATION), -1).otherwise(1).alias("polarity"))

    held = X.attach(numbers.select(place, "start", "end", F.struct("type", "surface").alias("surface")), people.select(place, "start", "end", "surface"))
    held = held.select("doc_id.doc_id", "doc_id.sentence_no", F.col("identifier.type").alias("type"), F.col("identifier.surface").alias("identifier"), "person", "i_start")
    kind = F.when(F.col("type") == "PHONE", "PHONE").otherwise("ACCOUNT")
    holds = held.join(told, ["doc_id", "sentence_no"]).select(
        "doc_id", "sentence_no", F.lit("HOLDS").alias("predicate"), S.person_key(F.col("case_code"), F.col("person")).alias("subject"), S.identifier_key(kind, F.col("identifier")).alias("object"),
        F.coalesce("stated", "document_day").alias("day"), "polarity", F.lit("stated in report").alias("detail"),
    )

    a = people.select("doc_id", "sentence_no", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("surface").alias("a"))
    b = people.select("doc_id", "sentence_no", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("surface").alias("b"))
    both = a.join(b, ["doc_id", "sentence_no"]).where("a_end <= b_start").join(told, ["doc_id", "sentence_no"])
    cue = link_cue(F.expr("substring(body, a_end + 1, b_start - a_end)"), F.expr("substring(body, b_end + 1, s_end - b_end)"))
    both = both.select("doc_id", "sentence_no", "a_start", "b_start", "stated", "polarity", S.person_key(F.col("case_code"), F.col("a")).alias("subject"), S.person_key(F.col("case_code"), F.col("b")).alias("object"), cue.alias("cue"))
    both = both.where("cue is not null and subject <> object")
    first = both.groupBy("doc_id", "sentence_no", "subject", "object").agg(F.min_by(F.struct("cue", "stated", "polarity"), F.struct("a_start", "b_start")).alias("x"))
    denied = (F.col("x.cue") == "denied") | (F.col("x.polarity") < 0)
    links = first.select(
        "doc_id", "sentence_no", F.lit("LINK").alias("predicate"), "subject", "object", F.col("x.stated").alias("day"), F.when(denied, -1).otherwise(1).alias("polarity"), F.when(denied, "denied").otherwise(F.col("x.cue")).alias("detail"),
    )
    return holds.unionByName(links).where("subject is not null and object is not null")


def link_cue(gap: Column, after: Column) -> Column:
    """How a sentence joins two names: denied, called, paid or associated; null if it merely names both."""
    before = F.lower(F.regexp_extract(gap, LINK_BEFORE, 1))
    joined = F.when(gap.rlike(PAIR_JOIN), F.lower(F.regexp_extract(after, LINK_AFTER, 1))).otherwise("")
    cue = F.when(before != "", before).otherwise(joined)
    denied = reduce(lambda a, b: a | b, (cue.startswith(p) for p in ("denied", "does not", "did not", "never")))
    called = reduce(lambda a, b: a | b, (F.contains(cue, F.lit(p)) for p in ("call", "phon", "contact", "touch")))
    paid = reduce(lambda a, b: a | b, (F.contains(cue, F.lit(p)) for p in ("paid", "remitted", "transferred")))
    return F.when(cue == "", None).when(denied, "denied").when(called, "called").when(paid, "paid").otherwise("associated")
