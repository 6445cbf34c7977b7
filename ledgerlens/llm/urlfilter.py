"""URL filtering: a list of rules, and boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones: the trees learn from a
bounded, seeded sample of them what allowed and blocked URLs look like and judge
the URLs that no rule fits.  Everything is DataFrame and SQL functions; the trees
are Spark's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_split, lower_ascii, materialize

#: (verdict, host, path); fixed values of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled URLs that are learnt from, at most.
SAMPLE = 20_000
TREES, DEPTH = 10, 4
#: Labelled URLs that a suffix's share is drawn towards the overall share by.
PRIOR = 20.0
#: Folds of the labelled URLs whose suffix statistics leave their own fold out.
LABEL_FOLDS = 5

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "symbol_ratio", "entropy", "host_entropy",
    "parameters", "longest_part", "has_fragment", "has_extension", "is_https", "suffix_share", "suffix_log_count", "site_share", "site_log_count",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased; both empty for null or without '://'."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, under in reversed(ordered):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        rule = F.when(fits, F.lit(at + under)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(column: str) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    share = f"(length({column}) - length(replace({column}, c, ''))) / length({column})"
    return F.expr(f"if(length({column}) = 0, 0D, aggregate(transform(array_distinct(split({column}, '')), c -> cast({share} as double)), 0D, (s, p) -> if(p > 0, s - p * log2(p), s)))")


def lexical(pages: DataFrame) -> DataFrame:
    """pages (url, host, path) with the lexical features that need no other row."""
    size = F.greatest(F.length("u"), F.lit(1))
    host_size = F.greatest(F.length("host"), F.lit(1))
    parts = F.split("host", "\\.")
    return pages.withColumn("u", F.coalesce("url", F.lit(""))).withColumns(
        {
            "url_length": F.length("u"),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.regexp_count("path", F.lit("/[^/]")),
            "labels": F.size(parts),
            "digit_ratio": F.regexp_count("u", F.lit("[0-9]")) / size,
            "host_digit_ratio": F.regexp_count("host", F.lit("[0-9]")) / host_size,
            "symbol_ratio": F.regexp_count("u", F.lit("[^A-Za-z0-9]")) / size,
            "entropy": _entropy("u"),
            "host_entropy": _entropy("host"),
            "parameters": F.regexp_count("u", F.lit("[?&][^?&#=]+=")),
            "longest_part": F.array_max(F.transform(F.split("u", "[^A-Za-z0-9]+"), F.length)),
            "has_fragment": F.contains("u", F.lit("#")).cast("int"),
            "has_extension": F.col("path").rlike("\\.[A-Za-z0-9]{1,5}$").cast("int"),
            "is_https": F.startswith("u", F.lit("https://")).cast("int"),
            "suffix": F.element_at(parts, -1),
            "site": F.substring_index("host", ".", -2),
        }
    )


def _with_statistics(pages: DataFrame, key: str) -> DataFrame:
    """pages with a suffix's share of blocked among labelled URLs and its count among all.

    A labelled URL's share comes from the labelled URLs of other folds only, so that
    no row's label is among its own features.  A URL's fold is drawn by its text:
    repeats of it are in one fold.  Common suffixes are dealt into parts for the join.
    """
    found = pages.groupBy(key, "fold").agg(F.count("*").alias("n"), F.count("label").alias("k"), F.sum(F.coalesce("label", F.lit(0.0))).alias("b"))
    total = found.agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    share = (total.b / total.k) if total.k else 0.5
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(LABEL_FOLDS) for c in "kb"]
    stats = found.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("b").alias("b"), *sums)
    own = {c: F.array(*[F.col(f"{c}{f}").cast("double") for f in range(LABEL_FOLDS)]) for c in "kb"}
    stats = stats.select(key, "n", "k", "b", own["k"].alias("own_k"), own["b"].alias("own_b"))
    joined = join_split(pages, stats, [key], ["page_id", "url"], total.n or 0)
    left = {c: F.col(c) - F.when(F.col("label").isNotNull(), F.get(f"own_{c}", F.col("fold"))).otherwise(0.0) for c in "kb"}
    added = {f"{key}_share": (left["b"] + PRIOR * share) / (left["k"] + PRIOR), f"{key}_log_count": F.log2(F.col("n") + 1.0)}
    return joined.withColumns(added).drop("n", "k", "b", "own_k", "own_b")


def features(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict), label (1.0 for block, 0.0 for allow, null without a rule) and FEATURES as doubles."""
    host, path = split_url(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, ruled = decide(F.col("host"), F.col("path"), rules)
    known = base.select("*", rule.alias("rule"), ruled.alias("ruled")).withColumn("label", F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.coalesce("url", F.lit(""))), F.lit(LABEL_FOLDS)).cast("int"))
    full = _with_statistics(_with_statistics(lexical(known), "suffix"), "site")
    columns = ["page_id", "host", "path", "rule", "ruled", "label", *(F.col(c).cast("double").alias(c) for c in FEATURES)]
    return full.select("url", *columns)


def fit_score(learnt: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Column:
    """The chance of block as a column over FEATURES, from boosted trees fitted to learnt (label, FEATURES)."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=3).fit(assembler.transform(learnt))
    # The margin as SQL: the weighted sum of the trees, each a nest of CASE expressions.
    margin = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.expr(_tree_sql(t)) for w, t in zip(model.treeWeights, model.trees, strict=True)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the method's chance of block, null where a rule decides).

    A null url or one without '://' has empty host and path, fits no rule and is
    judged by the trees like any other.  Repeated rows are judged each.  Without
    labelled URLs of both kinds the verdict of the only kind there is holds (allow
    if there is none).  Other columns are ignored; an empty table gives no rows.
    """
    full = materialize(features(pages, rules), "urlfilter-features")
    kinds = {r.label for r in full.where("label is not null").select("label").distinct().collect()}
    if len(kinds) < 2:
        other = F.lit(1.0 if kinds == {1.0} else 0.0)
        return full.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(other >= 0.5, "block").otherwise("allow")).alias("verdict"), F.when(F.col("ruled").isNull(), other).alias("score"))
    order = [F.xxhash64(F.lit("sample"), "page_id", "url"), "page_id", "url"]
    chosen = full.where("label is not null").orderBy(*order).limit(sample)
    score = fit_score(materialize(chosen.select("label", *FEATURES), "urlfilter-sample"), trees, depth)
    judged = full.withColumn("score", F.when(F.col("ruled").isNull(), score))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def _tree_sql(tree) -> str:
    """A regression tree as one SQL expression over the feature columns."""

    def node(n) -> str:
        if n.numDescendants() == 0:
            return f"{float(n.prediction())!r}D"
        split = n.split()
        name = FEATURES[split.featureIndex()]
        return f"CASE WHEN {name} <= {float(split.threshold())!r}D THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    return node(tree._java_obj.rootNode())
