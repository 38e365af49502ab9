"""URL filtering: a fixed rule list first, then association rules mined from urls that the list has judged.

A url's tokens are the parts of its host with their place from the right, the parts of its path with their place, a file
ending and the names of its query fields, with runs of digits made alike. Tokens that occur in the same urls are one item. FP-growth finds
item sets that are frequent among the labelled urls together with a verdict; sets whose verdict reaches the wanted support and confidence become rules. A rule is filed under its first item in an
inverted index; a url's items are looked up there and then compared whole. Spark expressions and Spark ML only.

Cases. A null url, or one without "://", has empty host and path, no tokens and the default verdict. Repeated pages are
judged alike; ids are not used. Without a labelled url, or with too few of them, there are no mined rules. Of rules that tie in confidence and
support the one whose verdict, then tokens, come last decides. Very long urls have many tokens, all of them looked up. An empty table gives an empty table.
Further columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits, else null. A rule fits its host and all subdomains of it."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The url's distinct tokens, sorted: every part of its host, path and query; runs of digits count alike, so ids are no tokens."""
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    hosts = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), plain(x)))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), plain(x)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    fields = F.filter(F.split(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "&"), lambda x: x != "")
    fields = F.transform(fields, lambda x: F.concat(F.lit("q:"), plain(F.element_at(F.split(x, "="), 1))))
    every = F.concat(hosts, paths, F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>")), fields)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def classes(labelled: DataFrame) -> DataFrame:
    """token, item: tokens that occur in the same labelled urls are one item, named by the first of them.

    Urls are told by their token sets; two tokens are in the same ones if their numbers and two 64-bit sums agree.
    """
    sets = labelled.select("tokens").distinct()
    each = sets.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("__a"), F.xxhash64(F.lit(1), "tokens").alias("__b"))
    where = each.groupBy("token").agg(F.count(F.lit(1)).alias("__n"), F.bit_xor("__a").alias("__a"), F.bit_xor("__b").alias("__b"))
    first = where.groupBy("__n", "__a", "__b").agg(F.min("token").alias("item"))
    return where.join(first, ["__n", "__a", "__b"]).select("token", "item")


def with_items(sets: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct tokens of sets with held: item to the last of the tokens that stand for it, without tokens that no labelled url has."""
    each = sets.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(known, "token")
    per = each.groupBy("tokens", "item").agg(F.max("token").alias("token"))
    return per.groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("held"))


def mine(labelled: DataFrame, support: float = 0.01, confidence: float = 0.9, least: int = 20, lift: float = 1.05, known: DataFrame | None = None) -> DataFrame:
    """Rules (antecedent, consequent, confidence, support) from labelled (tokens, verdict); antecedents are of items.

    An item stands for all tokens that occur in the same urls (known, by default classes(labelled)): a url has it if it has one of
    them, so a rule stands for all rules with other tokens of its items. Frequent sets of tokens would be exponential in the number of such tokens.

    support: the least share of the labelled urls that have antecedent and verdict, and least: their least number; lift: the
    least ratio of a rule's confidence to its verdict's share of all. A rule is dropped if a part of it says the same with
    at least its confidence. Rare tokens are in no frequent set, and FP-growth leaves them out first.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "antecedent array<string>, consequent string, confidence double, support double")
    total = labelled.count()
    if not total:
        return empty
    known = classes(labelled) if known is None else known
    held = labelled.join(with_items(labelled, known), "tokens", "left").select("verdict", F.coalesce(F.map_keys("held"), F.array().cast("array<string>")).alias("items"))
    baskets = held.select(F.concat("items", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    support = min(1.0, max(support, least / total))
    # No confidence is asked of Spark's own rules: they are formed from the frequent sets, with a verdict on the right.
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.99).fit(baskets).freqItemsets
    sets = written(sets.select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    is_verdict = lambda x: x.startswith("=")
    plain = sets.filter(~F.exists("items", is_verdict)).select(F.col("items").alias("antecedent"), F.col("freq").alias("__n"))
    judged = sets.filter(F.exists("items", is_verdict)).select(
        F.filter("items", lambda x: ~is_verdict(x)).alias("antecedent"), F.substring(F.element_at(F.filter("items", is_verdict), 1), 2, 20).alias("consequent"), "freq"
    )
    shares = sets.filter((F.size("items") == 1) & F.exists("items", is_verdict)).select(F.substring(F.element_at("items", 1), 2, 20).alias("consequent"), (F.col("freq") / F.lit(float(total))).alias("__share"))
    judged = judged.filter(F.size("antecedent") > 0).join(F.broadcast(shares), "consequent")  # a row per verdict
    judged = judged.join(plain, "antecedent").withColumn("confidence", F.col("freq") / F.col("__n")).withColumn("support", F.col("freq") / F.lit(float(total)))
    fine = (F.col("confidence") >= lift * F.col("__share")) & (F.col("confidence") >= confidence)
    judged = written(judged.select("antecedent", "consequent", "confidence", "support", fine.alias("fine"), F.size("antecedent").alias("size")), "url-judged")
    return _without_vain(judged, empty)


def _without_vain(judged: DataFrame, empty: DataFrame) -> DataFrame:
    """Of judged sets (antecedent, consequent, confidence, support, fine, size), fine ones of which no part is fine with their confidence.

    The best confidence of a set's parts is that of the sets with one item less and of their parts, which are looked up by
    name: sets go up by size, and no rule meets another one that is not such a part.
    """
    longest = judged.agg(F.max("size")).first()[0] or 0
    kept, below = empty, None
    for size in range(1, longest + 1):
        now = judged.filter(F.col("size") == size)
        if below is None:
            now = now.withColumn("best", F.lit(0.0))
        else:
            parts = now.select("antecedent", "consequent", F.posexplode("antecedent").alias("at", "left_out"))
            parts = parts.withColumn("part", F.array_remove("antecedent", F.col("left_out"))).drop("at", "left_out")
            best = parts.join(below, ["part", "consequent"]).groupBy("antecedent", "consequent").agg(F.max("best").alias("best"))
            now = now.join(best, ["antecedent", "consequent"])
        now = written(now, "url-level")
        kept = kept.unionByName(now.filter("fine and confidence > best").select(*empty.columns))
        below = now.select(F.col("antecedent").alias("part"), "consequent", F.greatest("best", F.when(F.col("fine"), F.col("confidence"))).alias("best"))
    return kept


def matched(token_sets: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """For each distinct tokens with a rule that fits: the verdict, of most confidence, then support, then by name, and the tokens that fit it."""
    index = rules.select(F.element_at("antecedent", 1).alias("__t"), "antecedent", "consequent", "confidence", "support")
    sets = with_items(token_sets, known)
    hits = sets.withColumn("__t", F.explode(F.map_keys("held"))).join(index, "__t").filter(F.size(F.array_except("antecedent", F.map_keys("held"))) == 0)
    hits = hits.withColumn("antecedent", F.array_sort(F.transform("antecedent", lambda x: F.col("held")[x])))
    best = hits.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "consequent", "antecedent")).alias("__best"))
    return best.select("tokens", F.col("__best.consequent").alias("mined"), F.col("__best.antecedent").alias("because"))


def judge(pages: DataFrame, rules=RULES, default: str = "allow", support: float = 0.01, confidence: float = 0.9, **how) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the mined rule's tokens if one decided."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "__listed": verdict, "tokens": tokens_of(F.col("url"), F.col("host"), F.col("path"))})
    labelled = rows.filter(F.col("__listed").isNotNull()).select("tokens", F.col("__listed").alias("verdict"))
    known = written(classes(labelled), "url-items")
    mined = written(mine(labelled, support, confidence, known=known, **how), "url-rules")
    found = matched(rows.filter(F.col("__listed").isNull()), mined, known)
    out = rows.join(found, "tokens", "left")
    free = F.col("__listed").isNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("__listed", "mined", F.lit(default)).alias("verdict"), F.when(free, F.col("because")).alias("because"))
