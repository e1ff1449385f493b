"""URL filters: given host and path rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import at_home, joined, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of the labelled URLs that a rule's tokens and label must occur in, tokens of a rule at most, and how much of
#: the way from the label's share among all URLs to certainty a rule's confidence must go.
MIN_SUPPORT, MAX_TOKENS, MIN_CERTAINTY = 0.02, 3, 0.1
LABELS = ["allow", "block"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z folded; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def tokens_of(url: Column) -> Column:
    """Different tokens of a URL: labels of the host, segments of the path and names in the query; all digits are 0."""
    host = F.transform(F.split(host_of(url), r"\."), lambda t: F.concat(F.lit("host:"), t))
    path = F.transform(F.split(path_of(url), "[/._-]"), lambda t: F.concat(F.lit("path:"), F.lower(t)))
    query = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda t: F.concat(F.lit("query:"), F.substring_index(t, "=", 1)))
    folded = F.transform(F.concat(host, path, query), lambda t: F.regexp_replace(t, "[0-9]+", "0"))
    return F.array_distinct(F.filter(folded, lambda t: ~t.endswith(":")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """tokens, label (allow or block), confidence, support and certainty of rules "URLs with these tokens have this label".

    labelled: url and bad (boolean). Spark's FP-growth finds the token sets that occur with a label in min_support of
    the URLs. As one label is much more frequent than the other, confidence is judged against the label's own share:
    certainty = (confidence - share) / (1 - share). Rules under the limits or of over MAX_TOKENS tokens are pruned, and
    so is a rule if a part of its tokens makes a rule for the same label that is as sure: the shorter one matches all
    that it matches. FP-growth brings its frequent single items to the driver, at most 1 / min_support times the
    average number of tokens.
    """
    verdict = F.concat(F.lit("label:"), F.when(F.col("bad"), "block").otherwise("allow"))
    baskets = stored(labelled.select(F.array_append(tokens_of(F.col("url")), verdict).alias("items")), "baskets")
    n = baskets.count()
    shares = {x: baskets.where(F.array_contains("items", f"label:{x}")).count() / max(1, n) for x in LABELS}
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(shares.values())).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("label:") & (F.size("antecedent") <= MAX_TOKENS))
    rules = rules.where(~F.exists("antecedent", lambda t: t.startswith("label:")))
    label = F.substring_index(F.col("consequent")[0], ":", -1)
    share = F.when(label == "block", F.lit(shares["block"])).otherwise(F.lit(shares["allow"]))
    certainty = (F.col("confidence") - share) / F.when(share < 1, 1 - share)
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), label.alias("label"), "confidence", "support", certainty.alias("certainty")).where(F.col("certainty") >= min_certainty)
    rules = stored(rules, "url-rules")
    parts = rules.select(F.col("tokens").alias("part"), "label", F.col("certainty").alias("part_certainty"), F.explode("tokens").alias("token"))
    longer = rules.withColumn("token", F.explode("tokens")).join(parts, ["token", "label"])
    longer = longer.where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("part_certainty") >= F.col("certainty")))
    return stored(rules.join(longer.select("tokens", "label").distinct(), ["tokens", "label"], "left_anti"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and verdict of the different urls that have all tokens of a rule; of several rules the surest decides.

    An inverted index finds them: a rule stands under that of its tokens which fewest urls have. A token of very many
    urls is met by a broadcast of fewer than HOT_KEYS rows (see shared.joined).
    """
    held = stored(urls.select("url", tokens_of(F.col("url")).alias("all")), "url-tokens").withColumn("token", F.explode("all"))
    used = rules.select(F.explode("tokens").alias("token")).distinct()
    frequency = held.join(used, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    placed = rules.withColumn("token", F.explode("tokens")).join(frequency, "token").groupBy("tokens", "label", "certainty")
    placed = placed.agg(F.min(F.struct("n", "token")).alias("least"), F.count(F.lit(1)).alias("known")).where(F.col("known") == F.size("tokens"))
    index = placed.groupBy(F.col("least.token").alias("token"), F.col("least.n").alias("n")).agg(F.collect_list(F.struct("certainty", "label", "tokens")).alias("rules"))
    index = stored(index, "rule-index")
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    fits = F.filter("rules", lambda r: F.size(F.array_except(r["tokens"], F.col("all"))) == 0)
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["certainty"].alias("certainty"), r["label"].alias("label"))))
    found = joined(held, index, ["token"], "n", total).select("url", best.alias("best")).where("best is not null")
    return found.groupBy("url").agg(F.max("best").alias("best")).select("url", F.col("best.label").alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each page.

    rules are (verdict, host/path): one fits its host and the subdomains of that if the url's path begins with its path,
    and the longest wins. Other URLs get the verdict of the surest mined rule that matches, without any allow. labels
    has doc_id (the page's id), quality and toxic; a page is bad with quality 0 or toxic 1. Without labels nothing is
    mined. Null urls have empty host and path and are allowed, those without :// have empty host and path; neither
    null urls nor those of a given rule take part in any join. Repeated rows are judged alike; very long urls are
    taken whole; an empty table gives no rows; pages' other columns are left behind.
    """
    pages, labels = at_home(pages, labels)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    verdict = rule = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, path = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + path)
        verdict, rule = (F.when(fits, x) if so_far is None else so_far.when(fits, x) for so_far, x in ((verdict, what), (rule, text)))
    rows = rows.withColumns({"rule": F.lit(None).cast("string") if rule is None else rule, "given": F.lit(None).cast("string") if verdict is None else verdict})
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad"))
    labelled = rows.where("url is not null").join(known, F.col("page_id") == F.col("doc_id")).select("url", "bad")
    undecided = F.col("given").isNull() & F.col("url").isNotNull()
    hits = stored(matched(rows.where(undecided).select("url").distinct(), mine(labelled)), "url-verdicts")
    mined = rows.where(undecided).join(hits, "url", "left").withColumn("given", F.coalesce("verdict", F.lit("allow")))
    columns = ["page_id", "host", "path", "rule"]
    return mined.select(*columns, F.col("given").alias("verdict")).unionByName(rows.where(~undecided).select(*columns, F.coalesce("given", F.lit("allow")).alias("verdict")))
