"""URL filter from association rules: FP-growth over URL tokens and labels, matched by an inverted index.

A URL is its set of tokens: scheme, host words, path words, query pairs and fragment, each with its kind in front
and runs of digits written as ``#``. Pages with a label are the transactions (page_id is looked up in ``labels``; of
several labels the lowest counts) and hold the item ``=low`` if the quality is 0. FP-growth gives the frequent
itemsets, and an antecedent X becomes a rule if X with ``=low`` has the support and the confidence asked for and no
rule over fewer of its tokens is as confident. Each rule is filed under its rarest token alone, so a URL meets it at
most once; joins carry no hints, so that the planner broadcasts the rules only if they are small.

FP-growth lists every frequent set, 2**n for pages that share n tokens, though a set says nothing new if one of its
tokens stands on every page that has the others, or if the others are sure of ``=low`` already. Transactions of more
than WIDE tokens are therefore projected first, as FP-growth's own recursion does: a transaction is written once for
each of its tokens, with the more frequent ones before it, without those that say nothing new beside it; again and
again, until they are narrow. Which rules are kept doesn't depend on WIDE.

NULL and empty URLs have no token, match nothing and are kept; a very long URL is taken whole. Repeated pages each get
their row; ties in rarity go to the first token, and rules of the same tokens' number and confidence all stay. Extra
columns, whatever their names, are ignored, or carried by ``drop_matching``. Without labelled pages no rule exists.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.kernel import unused
from weftgraph.session import shared_folder

#: Share of the labelled pages, and their number at least, in which a rule holds.
SUPPORT, LEAST = 0.001, 3
CONFIDENCE = 0.5
LOW = "=low"
#: Tokens of a transaction that FP-growth is given, at most.
WIDE = 10
RULES = "antecedent array<string>, token string, hits long, confidence double"


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, in order; none for NULL."""
    low = F.regexp_replace(F.lower(url), "[0-9]+", "#")
    rest = F.regexp_replace(low, "^[a-z]+://", "")
    path = F.regexp_replace(F.regexp_replace(rest, "^[^/?]*", ""), "[?].*$", "")

    def named(kind: str, text: Column, cut: str) -> Column:
        return F.transform(F.filter(F.split(text, cut), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    parts = (
        named("scheme:", F.regexp_extract(low, "^([a-z]+)://", 1), "/"),
        named("host:", F.regexp_extract(rest, "^([^/?]*)", 1), "[.:-]"),
        named("path:", path, "[/._-]"),
        named("query:", F.regexp_extract(low, "[?](.*)$", 1), "[&;]"),
    )
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*parts))), F.array().cast("array<string>"))


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """items, low: tokens of each labelled page, and whether its quality is 0."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    rows = pages.select("page_id", tokens(F.col("url")).alias("items")).join(known, "page_id")
    return rows.select("items", (F.col("quality") == 0).alias("low"))


def frequent(baskets: DataFrame, most: int, wide: int = WIDE) -> DataFrame:
    """antecedent, hits, freq of the token sets with that many hits of low quality; sets that say nothing new may be missing."""
    none = F.array().cast("array<string>")
    open_ = baskets.select(none.alias("tag"), "items", "low")
    found, narrow = [], []
    while True:
        open_ = open_.checkpoint().withColumn("row", F.monotonically_increasing_id())
        total = open_.groupBy("tag").agg(F.count("*").alias("all"))
        exploded = open_.select("tag", "row", "low", F.explode("items").alias("item"))
        counted = exploded.groupBy("tag", "item").agg(F.count("*").alias("freq"), F.sum(F.col("low").cast("int")).alias("hits")).filter(F.col("hits") >= most)
        own = counted.join(total, "tag").filter((F.size("tag") == 0) | (F.col("freq") < F.col("all"))).checkpoint()
        found.append(own.select(F.array_sort(F.array_append("tag", F.col("item"))).alias("antecedent"), "hits", "freq"))
        rest = own.filter("hits < freq").select("tag", "item", "freq")
        cut = exploded.join(rest, ["tag", "item"]).groupBy("tag", "row", "low").agg(F.array_sort(F.collect_list(F.struct(-F.col("freq"), "item"))).alias("items"))
        cut = cut.select("tag", "low", F.transform("items", lambda x: x["item"]).alias("items")).checkpoint()
        width = cut.groupBy("tag").agg(F.max(F.size("items")).alias("width"))
        narrow.append(cut.join(width.filter((F.col("width") > 1) & (F.col("width") <= wide)), "tag", "left_semi"))
        broad = cut.join(width.filter(F.col("width") > wide), "tag", "left_semi")
        if broad.isEmpty():
            break
        at = broad.select("tag", "low", "items", F.posexplode("items").alias("place", "item"))
        open_ = at.select(F.array_append("tag", F.col("item")).alias("tag"), F.expr("slice(items, 1, place)").alias("items"), "low")
    union = narrow[0]
    for part in narrow[1:]:
        union = union.unionByName(part)
    union = union.checkpoint()
    if n := union.count():
        named = lambda x: F.to_json(F.struct("tag", x.alias("item")))
        sets = union.select(F.transform(F.when(F.col("low"), F.array_append("items", F.lit(LOW))).otherwise(F.col("items")), named).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (most - 0.5) / n), minConfidence=1.0).fit(sets)
        read = F.transform("items", lambda x: F.from_json(x, "tag array<string>, item string"))
        mined = model.freqItemsets.select(read.alias("items"), "freq").select(F.col("items")[0]["tag"].alias("tag"), F.transform("items", lambda x: x["item"]).alias("items"), "freq").checkpoint()
        bad = mined.filter(F.array_contains("items", LOW)).select("tag", F.array_sort(F.array_remove("items", LOW)).alias("items"), F.col("freq").alias("hits"))
        plain = mined.filter(~F.array_contains("items", LOW) & (F.size("items") > 1)).select("tag", F.array_sort("items").alias("items"), "freq")
        found.append(bad.join(plain, ["tag", "items"]).select(F.array_sort(F.concat("tag", "items")).alias("antecedent"), "hits", "freq"))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def filed(rules: DataFrame, often: DataFrame) -> DataFrame:
    """Each rule with the token it is filed under: the rarest."""
    single = rules.select("antecedent", F.explode("antecedent").alias("token")).join(often, "token")
    rarest = single.groupBy("antecedent").agg(F.min(F.struct("pages", "token"))["token"].alias("token"))
    return rules.join(rarest, "antecedent").select("antecedent", "token", "hits", "confidence")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of sets (with a tokens column) once for each rule whose antecedent they contain."""
    pairs = sets.withColumn("token", F.explode("tokens")).join(rules, "token")
    return pairs.filter(F.size(F.array_intersect("antecedent", "tokens")) == F.size("antecedent")).drop("token")


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, wide: int = WIDE) -> DataFrame:
    """antecedent, token, hits, confidence of the rules that are kept; written to the shared folder."""
    spark = pages.sparkSession
    shared_folder(spark)
    baskets = transactions(pages, labels).checkpoint()
    total = baskets.count()
    if not total:
        return spark.createDataFrame([], RULES)
    sets = frequent(baskets, max(least, math.ceil(support * total)), wide).checkpoint()
    rules = sets.select("antecedent", "hits", (F.col("hits") / F.col("freq")).alias("confidence")).filter(F.col("confidence") >= confidence)
    often = sets.filter(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("token"), F.col("freq").alias("pages"))
    rules = filed(rules, often).checkpoint()
    wider = rules.select(F.col("antecedent").alias("tokens"), F.col("confidence").alias("own"))
    worse = matches(wider, rules).filter((F.size("antecedent") < F.size("tokens")) & (F.col("confidence") >= F.col("own"))).select(F.col("tokens").alias("antecedent")).distinct()
    return rules.join(worse, "antecedent", "left_anti").select("antecedent", "token", "hits", "confidence").checkpoint()


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, rules (number that match), confidence of the best (0 for none), keep; a row for each page."""
    rows = pages.select("page_id", "url")
    urls = rows.select("url").filter("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    found = matches(urls, rules).groupBy("url").agg(F.count("*").alias("rules"), F.max("confidence").alias("confidence"))
    return rows.join(found, "url", "left").select("page_id", "url", F.coalesce("rules", F.lit(0)).cast("long").alias("rules"), F.round(F.coalesce("confidence", F.lit(0.0)), 9).alias("confidence"), F.col("rules").isNull().alias("keep"))


def drop_matching(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages whose URL matches no rule, with all their columns."""
    sets = unused(pages, "tokens")
    urls = pages.select("url").filter("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    bad = matches(urls, rules).select(F.col("url").alias(sets)).distinct()
    return pages.join(bad, pages["url"] == bad[sets], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page, by rules mined from all labelled pages."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judged(pages, mine(pages, labels))


def _named(kind: str, text: str, cut: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array({text}, '{cut}'), lambda x: x <> ''), lambda x: '{kind}' || x)"


_TOKENS = "list_sort(list_distinct(" + " || ".join((
    _named("scheme:", "regexp_extract(low, '^([a-z]+)://', 1)", "/"),
    _named("host:", "regexp_extract(rest, '^([^/?]*)', 1)", "[.:-]"),
    _named("path:", "regexp_replace(regexp_replace(rest, '^[^/?]*', ''), '[?].*$', '')", "[/._-]"),
    _named("query:", "regexp_extract(low, '[?](.*)$', 1)", "[&;]"),
)) + "))"

#: Enumerates every set of frequent tokens in every labelled page, where FP-growth doesn't have to.
SQL = f"""
WITH RECURSIVE lowered AS (SELECT page_id, url, regexp_replace(lower(url), '[0-9]+', '#', 'g') AS low FROM pages),
cut AS (SELECT page_id, url, low, regexp_replace(low, '^[a-z]+://', '') AS rest FROM lowered),
tokened AS MATERIALIZED (SELECT page_id, url, {_TOKENS} AS tokens FROM cut),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
baskets AS MATERIALIZED (SELECT row_number() OVER () AS b, tokens, quality = 0 AS low FROM tokened JOIN known ON page_id = doc_id),
most AS (SELECT greatest({LEAST}, ceil({SUPPORT} * count(*))) AS m FROM baskets),
often AS MATERIALIZED (SELECT token, count(*) AS pages FROM (SELECT unnest(tokens) AS token FROM baskets) GROUP BY token HAVING count(*) >= (SELECT m FROM most)),
items AS MATERIALIZED (SELECT b, low, token FROM (SELECT b, low, unnest(tokens) AS token FROM baskets) JOIN often USING (token)),
subsets AS (
  SELECT b, low, [token] AS ante, token AS last FROM items
  UNION ALL
  SELECT s.b, s.low, list_append(s.ante, i.token), i.token FROM subsets s JOIN items i ON s.b = i.b AND i.token > s.last),
rules AS MATERIALIZED (
  SELECT ante, count(*) FILTER (low) AS hits, count(*) FILTER (low) / count(*) AS confidence FROM subsets GROUP BY ante
  HAVING count(*) FILTER (low) >= (SELECT m FROM most) AND count(*) FILTER (low) / count(*) >= {CONFIDENCE}),
kept AS MATERIALIZED (
  SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules o WHERE len(o.ante) < len(r.ante) AND o.confidence >= r.confidence AND list_has_all(r.ante, o.ante))),
found AS (SELECT url, count(*) AS rules, max(confidence) AS confidence FROM (SELECT DISTINCT url, tokens FROM tokened WHERE url IS NOT NULL) t JOIN kept ON list_has_all(tokens, ante) GROUP BY url)
SELECT page_id, t.url, coalesce(rules, 0)::BIGINT AS rules, round(coalesce(confidence, 0.0)::DOUBLE, 9) AS confidence, rules IS NULL AS keep
FROM tokened t LEFT JOIN found f ON t.url = f.url
"""
