"""URL filters: fixed rules by host and path, and association rules mined from labelled URLs.

A URL becomes a set of tokens (labels of its host, folders of its path, its file ending, names in its query; numbers
count as one token). FP-growth mines combinations of tokens that occur with a label; rules from tokens to a label are
kept by support, confidence and lift. Before that, tokens that always occur together are made one item: combinations of
them would all be frequent, two to the power of their number, and say the same. An antecedent names all tokens of its
items. An inverted index holds every rule under its rarest token, so a URL meets only rules that share that token, and
each of these is checked in full.

Everything is DataFrame functions and Spark's FP-growth. A null URL, or one without ``://``, has an empty host and path
and no tokens: no rule fits and it is allowed. Of several rules that fit, that of the highest confidence decides, then of
the highest support, then ``block``. Very long URLs have as many tokens as they have parts. Repeated rows are judged row
by row; of several labels of a page ``block`` counts. Labels that are null are not used; with no labels there are no
mined rules. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import save

#: Verdict and rule: a host and the beginning of the path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.5, 1.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path)."""
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    return pages.select(
        "page_id",
        "url",
        F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )


def fixed_rule(rules: list[tuple[str, str]]):
    """Column pair (rule, verdict) of the longest rule that fits host and path; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        host, slash, rest = r.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens():
    """The URL's distinct tokens, sorted: h: host labels, p: folders, e: file ending, q: names in the query."""
    number = "regexp_replace(x, '[0-9]+', '#')"
    return F.expr(
        f"""array_sort(array_distinct(filter(concat(
          transform(filter(split(host, '[.]'), x -> x != ''), x -> concat('h:', {number})),
          transform(filter(split(path, '/'), x -> x != ''), x -> concat('p:', regexp_replace({number}, '[.][a-z]+$', ''))),
          array(concat('e:', regexp_extract(path, '[.]([a-z]+)$', 1))),
          transform(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)', 1), x -> concat('q:', {number}))
        ), x -> length(x) > 2)))"""
    )


def merged(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(items, label) of ``labelled`` (id, tokens, label), and (item, tokens, freq) of items in at least ``least`` rows.

    An item stands for the tokens that occur in the same rows, told by their number and two sums of hashes of ids. There
    are at most as many items as a row has tokens on average, times the rows, by ``least``.
    """
    pairs = labelled.select("id", F.explode("tokens").alias("token"))
    facts = pairs.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 31))).alias("y")).filter(F.col("freq") >= least)
    items = save(facts.groupBy("freq", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.col("tokens")[0].alias("item"), "tokens", "freq"), "items")
    kept = pairs.join(items.select(F.col("item").alias("token")), "token").groupBy("id").agg(F.collect_list("token").alias("kept"))
    rows = labelled.join(kept, "id", "left").select(F.array_append(F.coalesce("kept", F.array().cast("array<string>")), F.concat(F.lit("label:"), "label")).alias("items"))
    return rows, items


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(antecedent, verdict, confidence, support, lift, key) from ``labelled`` (id, tokens, label), written; key: the rarest token.

    ids are unique; labelled is a written table."""
    labelled = labelled.filter("label is not null and size(tokens) > 0")
    rows, items = merged(labelled, max(1, math.ceil(min_support * labelled.count())))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith("label:") & (F.col("lift") >= min_lift))
    rules = save(rules.select(F.monotonically_increasing_id().alias("rule_id"), "antecedent", F.substring(F.col("consequent")[0], 7, 1000).alias("verdict"), "confidence", "support", "lift"), "rules")
    # Every part of a frequent combination is frequent itself.
    whole = rules.select("rule_id", F.explode("antecedent").alias("item")).join(items, "item").groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("all"), F.min(F.struct("freq", "item"))["item"].alias("key"))
    return save(rules.join(whole, "rule_id").select(F.col("all").alias("antecedent"), "verdict", "confidence", "support", "lift", "key"), "mined")


def mined_verdicts(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined) of distinct token sets, written: the verdict of the fitting rule of the highest confidence, then support."""
    met = sets.select("tokens", F.explode("tokens").alias("key")).join(rules.select("key", "antecedent", "verdict", "confidence", "support"), "key")
    fit = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    return save(fit.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "verdict"))["verdict"].alias("mined")), "verdicts")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for each row of ``pages`` (page_id, url).

    labels: (page_id, label 'allow' or 'block'). verdict: the fixed rule's, else the mined rules', else allow.
    """
    rule, fixed = fixed_rule(RULES if rules is None else rules)
    known = save(parsed(pages).withColumn("tokens", tokens()), "known")
    one = labels.filter("page_id is not null and label is not null").groupBy("page_id").agg(F.max("label").alias("label"))
    labelled = save(known.join(one, "page_id").select(F.monotonically_increasing_id().alias("id"), "tokens", "label"), "labelled")
    found = mine(labelled, min_support, min_confidence)
    verdicts = mined_verdicts(known.select("tokens").distinct(), found)
    out = known.join(verdicts, "tokens", "left")  # two written tables: Spark can divide the pages of one shape
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, "mined", F.lit("allow")).alias("verdict"), "mined")
