"""URL filters by association rules; DataFrame and SQL functions and Spark's own FP-growth only.

A url is a set of tokens (scheme, host labels and their hyphenated parts, path words, query keys).
FP-growth mines frequent token sets of labelled urls together with their label, which comes from the
quality labels and never from the given rules, so that a rule says something new. Tokens that stand in
the same labelled rows are mined as one item, of which a url needs any one token (that is what rules of
each of them would say), and tokens of all rows or of too few are left out, so that long shared
paths don't multiply item sets. Rules that conclude "block" with enough rows, support, confidence
and lift are kept, and rules that contain a shorter kept rule are dropped. Each rule stands in an
inverted index under its rarest item; a url is looked up by its items and blocked if all items of a
rule found so are among them. A list of given rules (host and path prefix, longest wins) comes first.

Defined cases: a null url, or one without ://, has an empty host and path, no given rule, and the
method's verdict on no tokens, allow; without labels, or with fewer blocked ones than a rule needs,
nothing is mined; of several rules that fit, the one of highest confidence, then support, then name is
named; equal urls share one lookup; labels that repeat a url count each; rows may repeat; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, small

#: The given rules, verdict and host with path.
GIVEN = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BLOCK = "=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*([\s\S]*)", 1)


def tokens(host: Column, path: Column, tail: Column, url: Column) -> Column:
    words = lambda c, by, mark: F.transform(F.split(F.lower(c), by), lambda x: F.concat(F.lit(mark), x))
    labels = words(host, r"\.", "h:")
    parts = F.flatten(F.transform(F.filter(F.split(F.lower(host), r"\."), lambda x: x.rlike("[-_]")), lambda x: F.transform(F.split(x, "[-_]"), lambda y: F.concat(F.lit("w:"), y))))
    paths = words(path, r"[/.\-_]", "p:")
    keys = F.transform(F.regexp_extract_all(tail, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), F.lower(x)))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    every = F.when(F.instr(url, "://") > 0, F.concat(scheme, labels, parts, paths, keys)).otherwise(F.array().cast("array<string>"))
    # numbers name single pages, and a mark alone says nothing
    return F.array_distinct(F.filter(every, lambda x: ~x.rlike(r"^[a-z]:\d*$")))


#: Labelled rows that a rule must rest on at least.
LEAST_ROWS = 5
ITEMS = "rule_id string, items array<string>, key string, confidence double, support double"


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, min_lift: float = 1.5, least_rows: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """labelled: url, blocked (boolean). Returns the rules (rule_id, items, key, confidence, support; the key is the rarest item) and
    the items that tokens stand for (token, item)."""
    spark = labelled.sparkSession
    host, path, tail = url_parts(F.col("url"))
    rows = labelled.where("url is not null and blocked is not null")
    rows = rows.select(F.col("url").cast("string").alias("url"), "blocked")
    rows = checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "blocked", tokens(host, path, tail, F.col("url")).alias("tokens")))
    total, blocked = rows.agg(F.count("*"), F.count_if("blocked")).first()
    if blocked < least_rows:
        return spark.createDataFrame([], ITEMS), spark.createDataFrame([], "token string, item string")
    support = max(min_support, least_rows / total)
    each = rows.select("row", F.explode("tokens").alias("token"))
    # tokens of the same rows: equal counts and two equal sums of row hashes, 128 bits
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64(F.lit(1), "row").cast("decimal(20,0)")).alias("y"))
    seen = seen.where((F.col("n") >= F.lit(support * total)) & (F.col("n") < total))
    items = checkpoint(seen.groupBy("n", "x", "y").agg(F.collect_list("token").alias("tokens")).select(F.array_min("tokens").alias("item"), F.explode("tokens").alias("token")).select("token", "item"))
    held = each.join(small(items), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = rows.join(held, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.col("lift") >= min_lift))
    found = found.select(F.array_sort("antecedent").alias("items"), "confidence", "support").withColumn("rule_id", F.array_join("items", " "))
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("item"), F.col("freq"))
    rare = found.select("rule_id", F.explode("items").alias("item")).join(small(single), "item").groupBy("rule_id").agg(F.min(F.struct("freq", "item")).alias("rarest"))
    found = checkpoint(found.join(rare, "rule_id").select("rule_id", "items", F.col("rarest.item").alias("key"), "confidence", "support"))
    # a rule that a shorter rule implies adds nothing; the shorter one stands in the index under its rarest item
    longer = found.select("rule_id", F.col("items").alias("more"), F.explode("items").alias("key"))
    implied = longer.join(found.select("key", "items"), "key").where((F.size("items") < F.size("more")) & (F.size(F.array_except("items", "more")) == 0)).select("rule_id").distinct()
    return checkpoint(found.join(implied, "rule_id", "left_anti")), items


def given_rule(given: list[tuple[str, str]]) -> Column:
    """The longest given rule that fits the columns host and path: struct(n, rule, verdict), or null."""
    fitting = []
    for verdict, rule in given:
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fitting)))


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", given: list[tuple[str, str]] | None = None, **mining) -> DataFrame:
    """Per row: id, host, path, rule, verdict, mined (the mined rule that decided, or null), confidence.

    What the given list says is computed on the row; only urls with tokens are looked up, once each, and only if there are rules."""
    given = GIVEN if given is None else given
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rules, items = mine_rules(labelled, **mining)
    plain = F.instr("url", "://") == 0
    nothing = [F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence")]
    if rules.limit(1).count():
        urls = rows.where(~plain).select("url").distinct()
        host, path, tail = url_parts(F.col("url"))
        each = urls.select("url", F.explode(tokens(host, path, tail, F.col("url"))).alias("token")).join(small(items), "token")
        held = each.groupBy("url").agg(F.collect_set("item").alias("has"))
        hits = held.select("url", "has", F.explode("has").alias("key")).join(small(rules), "key")
        hits = hits.where(F.size(F.array_except("items", "has")) == 0).groupBy("url").agg(F.max(F.struct("confidence", "support", "rule_id")).alias("best"))
        found = rows.where(~plain).join(hits, "url", "left").select("id", "url", F.col("best.rule_id").alias("mined"), F.col("best.confidence").alias("confidence"))
        rows = found.unionByName(rows.where(plain).select("id", "url", *nothing))
    else:
        rows = rows.select("id", "url", *nothing)
    host, path, _ = url_parts(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), "mined", "confidence").withColumn("best", given_rule(given))
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "mined", "confidence")


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked of the pages whose url ends its path with the number of a document that has a quality label."""
    number = F.regexp_extract("url", r"/(\d{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return numbered.join(quality, "doc_id").select("url", (F.col("quality") == 0).alias("blocked"))
