"""URL filters: listed rules first, and association rules mined from labelled urls for the others.

A url's tokens are the labels of its host and the words of its path, query and fragment. The combinations
of tokens that are frequent among labelled urls together with a verdict are mined level by level;
those of enough support and confidence become rules, without those that a shorter rule makes
superfluous. An inverted index from each rule's rarest token finds the rules whose tokens a url holds; the
most confident one decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.llm.common import removed, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of the labelled urls that hold a rule's tokens and its verdict, and least share of those with its tokens.
LEAST_SHARE, LEAST_CONFIDENCE = 0.002, 0.9
#: Tokens of a labelled url that take part in mining: all of its frequent ones.
MOST_ITEMS = None
ALLOW, BLOCK = "allow", "block"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where it is null or holds no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url: ``host x``, ``path x`` and ``rest x`` (query, fragment, or all of a url
    without ``://``) for its words in lower case, a number being ``#``."""
    host, path = url_parts(url)
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "(?s)[?#].*", 0)).otherwise(url), F.lit(""))

    def words(kind: str, text: Column) -> Column:
        found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
        return F.transform(found, lambda w: F.concat(F.lit(f"{kind} "), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))

    return F.array_distinct(F.concat(words("host", host), words("path", path), words("rest", rest)))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path joined) and verdict of the longest listed (host, path, verdict) that fits, else nulls.

    A rule fits its host and all subdomains, where the path starts with its own. Of equally long rules the
    one of the longer host is taken. The list becomes one expression, so it should hold hundreds at most.
    """
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def picked(tokens: Column, rank: dict[str, tuple], most: int | None, spark) -> Column:
    """Of an array of tokens those in ``rank``, sorted; where there are more than ``most``, those of least rank.

    The dictionary is sent to all tasks: it holds frequent tokens only, at most as many as a url has tokens
    on average over the least share.
    """
    held = spark.sparkContext.broadcast(rank)

    @F.pandas_udf("array<string>")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        for batch in batches:
            out = []
            for row in batch:
                known = [t for t in row if t in own]
                out.append(sorted(sorted(known, key=own.__getitem__)[:most]))
            yield pd.Series(out, dtype=object)

    return pick(tokens)


def mined_rules(labelled: DataFrame, least_share: float = LEAST_SHARE, least_confidence: float = LEAST_CONFIDENCE, most_items: int | None = MOST_ITEMS) -> DataFrame:
    """items (sorted tokens), verdict, confidence, support (a share), key (the rarest of the items): rules mined from
    all rows of labelled (tokens, verdict).

    A token is frequent if it occurs in ``least_share`` of the rows. All of a row's frequent tokens take part, unless
    ``most_items`` is given: then those whose share of either verdict differs most from that of all rows, in standard
    deviations (ties by token). A rule goes if the same without one of its items is a rule of the same verdict that is at
    least as confident.

    So a combination is carried on only while it occurs less often than each of its parts (else it says what the part says), has rows
    of both verdicts (else nothing added makes it more confident), and one of the verdicts is frequent in it. Each level joins
    the combinations of a url that differ in their last token; tokens that always occur together go no further than pairs. What is
    left out this way would be superfluous, so the rules are those of all combinations.
    """
    spark = labelled.sparkSession
    total = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, blocked = sum(total.values()), total.get(BLOCK, 0)
    if not rows:
        return spark.createDataFrame([], "items array<string>, verdict string, confidence double, support double, key string")
    counts = labelled.select(F.explode("tokens").alias("token"), "verdict").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == BLOCK).alias("blocked"))
    rank = {}
    for r in counts.where(F.col("n") >= least_share * rows).toLocalIterator():
        rank[r["token"]] = (-abs(r["blocked"] - r["n"] * blocked / rows) / r["n"] ** 0.5, r["token"])
    known = labelled.select(picked(F.col("tokens"), rank, most_items, spark).alias("own"), "verdict").where(F.size("own") > 0)
    baskets = written(known.groupBy("own").agg(F.count_if(F.col("verdict") == ALLOW).alias(ALLOW), F.count_if(F.col("verdict") == BLOCK).alias(BLOCK)).withColumn("basket", F.monotonically_increasing_id()), "baskets")
    held = baskets.select("basket", ALLOW, BLOCK, F.explode("own").alias("item")).select("basket", ALLOW, BLOCK, F.array("item").alias("items"))
    least, levels, before = ceil(least_share * rows), [], None
    while True:
        found = held.groupBy("items").agg(F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK)).where(F.greatest(ALLOW, BLOCK) >= least).withColumn("n", F.col(ALLOW) + F.col(BLOCK))
        if before is not None:
            part = found.withColumn("gone", F.explode("items")).select("items", "n", F.array_remove("items", F.col("gone")).alias("less"))
            parts = part.join(before.select(F.col("items").alias("less"), F.col("n").alias("part_n")), "less").where("part_n > n")
            found = found.join(parts.groupBy("items").agg(F.count(F.lit(1)).alias("parts")), "items").where(F.col("parts") == F.size("items")).drop("parts")
        found = written(found, "level")
        levels.append(found)
        before = found.where((F.col(ALLOW) > 0) & (F.col(BLOCK) > 0)).select("items", "n")
        if not before.limit(1).count():
            break
        own = written(held.join(before.select("items"), "items", "left_semi").withColumns({"head": F.slice("items", 1, F.size("items") - 1), "last": F.element_at("items", -1)}), "held")
        other = own.select("basket", "head", F.col("last").alias("next"))
        held = own.join(other, ["basket", "head"]).where("last < next").select("basket", ALLOW, BLOCK, F.array_append("items", F.col("next")).alias("items"))
    single = levels[0].select(F.col("items")[0].alias("item"), F.col("n").alias("freq"))
    every = levels[0]
    for found in levels[1:]:  # as many as the longest rule has items
        every = every.unionByName(found)
    told = every.select("items", "n", F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("held")) for v in (ALLOW, BLOCK)])).alias("t")).select("items", "t.verdict", (F.col("t.held") / F.col("n")).alias("confidence"), (F.col("t.held") / rows).alias("support"), F.col("t.held").alias("held"))
    rules = written(told.where((F.col("held") >= least) & (F.col("confidence") >= least_confidence)).drop("held"), "rules")
    shorter = rules.select(F.col("items").alias("less"), "verdict", F.col("confidence").alias("known"))
    part = rules.where(F.size("items") > 1).withColumn("gone", F.explode("items")).withColumn("less", F.array_remove("items", F.col("gone")))
    spare = part.join(shorter, ["less", "verdict"]).where("known >= confidence").select("items", "verdict").distinct()
    kept = rules.join(spare, ["items", "verdict"], "left_anti")
    keyed = kept.withColumn("item", F.explode("items")).join(single, "item").groupBy("items", "verdict").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min_by("item", F.struct("freq", "item")).alias("key"))
    out = written(keyed, "index")
    removed(spark, baskets, rules, *levels)
    return out


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``mined``, the verdict of the most confident rule whose tokens are all among ``tokens``, else null.

    Ties go to the rule of more support, then to block. Urls of the same tokens in rules are judged once.
    """
    spark = urls.sparkSession
    known = {r["item"]: (r["item"],) for r in rules.select(F.explode("items").alias("item")).distinct().toLocalIterator()}
    urls = urls.withColumn("own", picked(F.col("tokens"), known, None, spark))
    sets = urls.select("own").where(F.size("own") > 0).distinct()
    met = sets.withColumn("key", F.explode("own")).join(rules, "key").where(F.size(F.array_except("items", "own")) == 0)
    best = met.groupBy("own").agg(F.max(F.struct("confidence", "support", "verdict"))["verdict"].alias("mined"))
    return urls.join(written(best, "judged"), "own", "left").drop("own")  # written, so that its size is known


def judged_urls(pages: DataFrame, listed: list[tuple[str, str, str]], labelled: DataFrame | None = None, least_share: float = LEAST_SHARE, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    The longest listed rule that fits decides. The other urls are judged by rules mined from labelled
    (url, verdict), by default the pages that a listed rule fits; where none matches, a url is allowed.
    Null urls and urls without ``://`` have empty host and path, fit no listed rule, and are judged by the
    words they have. Repeated rows are rows each; labelled rows without url or verdict say nothing.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "listed": verdict})
    labels = rows.select("url", F.col("listed").alias("verdict")) if labelled is None else labelled.select("url", "verdict")
    labels = labels.where(F.col("url").isNotNull() & F.col("verdict").isNotNull())
    rules = mined_rules(labels.select(url_tokens(F.col("url")).alias("tokens"), "verdict"), least_share, least_confidence)
    open_ = matched(rows.where("rule is null").withColumn("tokens", F.coalesce(url_tokens(F.col("url")), F.array().cast("array<string>"))), rules)
    closed = rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("listed").alias("verdict"))
    return closed.unionByName(open_.select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(ALLOW)).alias("verdict")))
