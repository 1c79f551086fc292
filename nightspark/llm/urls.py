"""URL filter by association rules.

Only DataFrame functions and Spark's FP-growth.  Tokens of labelled URLs and
the label "bad" are the items; rules tokens -> bad, pruned by support,
confidence and lift, block.  Rules are matched by an inverted index on their
rarest token.  Given host rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import ascii_lower, cut, table

BAD = "label:bad"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


# fixed values: the given rules
RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
# end of fixed values


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """(rule, verdict) of the longest given rule that fits, else null; ties go to the first given."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path parts (digits as #), query keys; null and empty URLs have none."""
    text = ascii_lower(F.coalesce(url, F.lit("")))
    parts = lambda x, gap: F.filter(F.split(x, gap), lambda y: y != "")
    tag = lambda x, kind: F.transform(x, lambda y: F.concat(F.lit(kind), y))
    path = F.regexp_replace(path_of(text), r"[0-9]+", "#")
    keys = F.transform(parts(F.regexp_extract(text, r"\?([^#]*)", 1), "&"), lambda y: F.regexp_extract(y, "^[^=]*", 0))
    return F.array_distinct(F.concat(
        tag(parts(F.regexp_extract(text, r"^([a-z]+)://", 1), " "), "scheme:"), tag(parts(host_of(text), r"[.:]"), "host:"),
        tag(parts(path, r"[/._-]"), "path:"), tag(F.filter(keys, lambda y: y != ""), "key:")))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5, min_lift: float = 1.2, most_common: float = 0.95,
    min_rows: int = 20,
) -> DataFrame:
    """(tokens, confidence, support, pivot, classes): token sets that make "bad" likely; pivot is the rarest token.

    Tokens that stand in exactly the same labelled URLs are one item, named by
    the smallest of them: each of them makes the same rules, of which all
    combinations would be 2^n.  ``classes`` holds, for each of ``tokens``, the
    tokens it stands for (a URL needs one of each).

    ``labelled`` has columns tokens and bad.  Tokens on ``most_common`` or more
    of the URLs tell nothing and are no items; a rule holds for ``min_rows``
    labelled URLs at least, so that few labels make no rules.  FP-growth sends frequent single
    items to the driver: their number is bounded by the items of a URL over
    ``min_support``, whatever the input.
    """
    row = F.monotonically_increasing_id()
    items = cut(labelled.select("tokens", "bad", row.alias("row")), "url-items")
    total = items.count()
    # two 64-bit sums over the rows of a token tell in which URLs it stands
    sums = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    counts = cut(items.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), *sums), "url-tokens")
    support = min(1.0, max(min_support, min_rows / max(total, 1)))
    used = counts.filter((F.col("n") < most_common * max(total, 1)) & (F.col("n") >= support * total - 0.5))
    like = cut(used.groupBy("n", "s1", "s2").agg(F.sort_array(F.collect_set("token")).alias("members")), "url-classes")
    named = like.select(F.explode("members").alias("token"), F.element_at("members", 1).alias("item"))
    own = items.select("row", F.explode("tokens").alias("token")).join(named, "token").groupBy("row").agg(F.collect_set("item").alias("own"))
    tokens = F.coalesce("own", F.array().cast("array<string>"))
    baskets = items.join(own, "row", "left").select(F.when(F.col("bad"), F.array_append(tokens, BAD)).otherwise(tokens).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = cut(model.associationRules.filter((F.col("support") * max(total, 1) >= min_rows - 0.5) & (F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift)).select(
        F.sort_array("antecedent").alias("tokens"), "confidence", "support"), "url-rules")
    classes = like.select(F.element_at("members", 1).alias("token"), "n", "members")
    single = rules.select("tokens", F.explode("tokens").alias("token")).join(classes, "token").groupBy("tokens").agg(
        F.min(F.struct("n", "token")).alias("least"), F.sort_array(F.collect_list("members")).alias("classes"))
    return rules.join(single, "tokens").select("tokens", "confidence", "support", F.col("least.token").alias("pivot"), "classes")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence): the strongest rule of whose token classes the URL has one each; URLs without one are not returned.

    ``urls`` has distinct url and their tokens; ``rules`` are few (bounded by their support).
    """
    pivots = F.element_at(F.filter("classes", lambda c: F.array_contains(c, F.col("pivot"))), 1)
    index = rules.select(F.explode(pivots).alias("_token"), F.col("classes").alias("_rule"), "confidence")
    posted = urls.select("url", "tokens", F.explode("tokens").alias("_token")).join(index, "_token")
    return posted.filter(F.forall("_rule", lambda c: F.arrays_overlap(c, F.col("tokens")))).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[HostRule] = RULES, **mining: float,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, confidence (of the mined rule, else null).

    ``labels`` has doc_id (a page id), quality and toxic: a page is bad if any
    of its label rows has quality 0 or toxic 1; a null counts as neither.
    Without labels or rules the method allows.  Null URLs and those without
    ``://`` have an empty host and path.  Null ids are kept, repeated rows
    judged alike, other columns ignored; no pages give no rows.  Equal URLs are
    matched once, before the join back, which Spark splits for a hot URL.
    """
    base = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("url"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce((F.col("toxic") == 1), F.lit(False))).alias("bad"))
    labelled = base.join(marks, F.col("_id") == F.col("_doc")).select(url_tokens(F.col("url")).alias("tokens"), "bad")
    mined = cut(mine_rules(labelled, **mining), "url-index")
    distinct = base.select("url").filter("url IS NOT NULL").distinct().withColumn("tokens", url_tokens(F.col("url")))
    hits = matched(distinct, mined).select(F.col("url").alias("_url"), "confidence")
    out = base.join(hits, F.col("url") == F.col("_url"), "left").select(
        "_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "confidence")
    out = out.withColumn("_given", given_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select(
        F.col("_id").alias(page_id), "host", "path", F.col("_given.rule").alias("rule"),
        F.coalesce("_given.verdict", own).alias("verdict"), "confidence")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
