"""URL filter: listed rules first, else words of host and path scored by multinomial naive Bayes.

Concatenated names are split into words by a unigram Viterbi pass; the unigrams are counted over the pages'
own texts and over the parts that authors separate by hyphens. The classifier learns from addresses that name a
blocked topic outright, in a part of their own, and so learns the words that go with it; split names then count too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import arrow_rows
from cuefold.session import durable

# The production rules, and words that name a blocked topic.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TOPICS = (
    "adult", "porn", "porno", "xxx", "sex", "nude", "escort", "casino", "casinos", "bet", "bets", "betting", "poker", "slots", "gamble",
    "gambling", "jackpot", "viagra", "pills", "warez", "keygen", "phishing", "malware", "spam", "ads", "adserver", "popup", "clickbait",
)
#: Longest word of the dictionary, in characters; longer pieces of a name count as unknown.
LONGEST = 24
#: Keys of a join that are held apart because they are frequent: a fixed number, each with a short key.
FREQUENT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def names_in(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit("[a-z\\P{ASCII}]+"), 0)


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of an address; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    return folded(part(1)), part(2)


def fitting_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule whose host is the address's or above it and whose path starts its path, and its action.

    Of equal ones a blocking rule wins, then the lesser in order. Rules are a short list of a policy, not a table.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1]), reverse=False):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def join_counted(left: DataFrame, right: DataFrame, key: str, weight: str, most: int = FREQUENT) -> DataFrame:
    """Inner join with a table of one row per key, its frequent keys held apart.

    The `most` keys of the greatest `weight` with at most 64 characters go to every task: a bounded number
    of short rows. So no key with many rows on the left is shuffled; the rest meet by a shuffle.
    """
    top = durable(right.where(F.length(key) <= 64).orderBy(F.desc(weight), key).limit(most))
    near = left.join(F.broadcast(top), key)
    far = left.join(F.broadcast(top.select(key)), key, "left_anti").join(right, key)
    return near.unionByName(far)


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n): words of the pages' texts, tags taken out, that are no longer than `LONGEST`."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^<>]*>", " ")
    return pages.select(F.explode(names_in(text)).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def separated_words(urls: DataFrame) -> DataFrame:
    """(word, n): parts of names that their authors separated by hyphens."""
    labels = F.split(folded(F.concat_ws(".", "host", "path")), r"[./:_?=&%]+")
    hyphened = urls.select(F.explode(labels).alias("label")).where(F.contains("label", F.lit("-")))
    return hyphened.select(F.explode(names_in(F.col("label"))).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of a name. counts: of the known words at (start, length).

    A known word has the share of its count; a stretch that is unknown, of up to `LONGEST` characters,
    10 / (total * 10^length). Of equal splits the one whose last words are longer wins.
    """
    known = {}
    for (start, size), n in counts.items():
        known.setdefault(start + size, []).append((size, math.log10(n / total)))
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        choices = [(best[end - size] + 1 - math.log10(total) - size, size) for size in range(1, min(end, LONGEST) + 1)]
        choices += [(best[end - size] + score, size) for size, score in known.get(end, ())]
        score, size = max(choices)
        best.append(score)
        back.append(size)
    words, end = [], len(name)
    while end:
        words.append(name[end - back[end] : end])
        end -= back[end]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(name, words): each distinct name split into words. words: (word, n)."""
    schema = pa.schema([("name", pa.string()), ("start", pa.int32()), ("size", pa.int32()), ("word", pa.string())])

    def stretches(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (name,) in rows:
            for start in range(len(name)):
                for size in range(1, min(LONGEST, len(name) - start) + 1):
                    yield name, start, size, name[start : start + size]

    all_parts = names.select("name").mapInArrow(arrow_rows(stretches, schema, 5000), "name string, start int, size int, word string")
    met = join_counted(all_parts, words, "word", "n").groupBy("name").agg(F.collect_list(F.struct("start", "size", "n")).alias("parts"))
    out = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])

    def split(rows: Iterator[tuple]) -> Iterator[tuple]:
        for name, parts in rows:
            yield name, split_name(name, {(p["start"], p["size"]): p["n"] for p in parts or ()}, total)

    return names.select("name").join(met, "name", "left").select("name", "parts").mapInArrow(arrow_rows(split, out), "name string, words array<string>")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, topics: Sequence[str] = TOPICS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words) of pages (page_id, url, html): every row judged.

    verdict is the rule's; without one it is `block` where the score is above 0: the logarithm (in millionths)
    of the ratio of the classes, the prior's and that of each word of host and path, repeats counted. A row
    without any name, such as a null address, scores 0. Digits and separators part names. words is the host's
    words, spaced. Rows that repeat a page_id are judged one by one. An empty table gives no rows; only page_id, url and html are read.
    """
    host, path = address_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    urls = durable(
        durable(parts).withColumn("row", F.monotonically_increasing_id())
        .withColumn("host_names", names_in(F.col("host"))).withColumn("path_names", names_in(F.col("path")))
        .withColumn("blocked", F.arrays_overlap(F.concat("host_names", "path_names"), F.array(*map(F.lit, topics))).cast("long"))
    )
    named = urls.select("row", "blocked", F.posexplode(F.concat("host_names", "path_names")).alias("place", "name"), F.size("host_names").alias("n_host"))
    names = durable(named.groupBy("name").agg(F.sum("blocked").alias("block"), F.sum(1 - F.col("blocked")).alias("allow"), F.count(F.lit(1)).alias("n")))
    counted = page_words(pages).unionByName(separated_words(urls)).groupBy("word").agg(F.sum("n").alias("n"))
    words = durable(counted)
    total = max(words.agg(F.sum("n")).first()[0] or 0, 1)
    split = durable(segmented(names, words, total).join(names, "name"))

    # A row that names a topic only inside a split name is neither sample: it is what the classifier is for.
    topical = split.where(F.arrays_overlap("words", F.array(*map(F.lit, topics)))).select("name", "n")
    hinted = durable(join_counted(named.where("blocked = 0").select("row", "name"), topical, "name", "n").select("row").distinct())
    unsure = named.join(hinted, "row", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("unsure"))
    sampled = split.join(unsure, "name", "left").withColumn("allow", F.col("allow") - F.coalesce("unsure", F.lit(0)))

    one = sampled.select("name", F.explode("words").alias("word"), "block", "allow", "n")
    seen = durable(one.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.sum("n").alias("n")))
    t = seen.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first()
    n_block, n_allow, size = t[0] or 0, t[1] or 0, t[2]
    whole = urls.agg(F.sum("blocked"), F.count(F.lit(1))).first()
    blocked = whole[0] or 0
    prior = math.floor(1e6 * math.log((blocked + 1) / (whole[1] - blocked - hinted.count() + 1)))
    ratio = ((F.col("block") + 1) / (n_block + max(size, 1))) / ((F.col("allow") + 1) / (n_allow + max(size, 1)))
    weights = seen.select("word", F.floor(1e6 * F.log(ratio)).alias("weight"), "n")
    by_name = join_counted(one.select("name", "word"), weights, "word", "n").groupBy("name").agg(F.sum("weight").alias("weight"))
    scores = durable(by_name.join(split.select("name", F.array_join("words", " ").alias("text"), "n"), "name"))
    told = join_counted(named.drop("blocked"), scores, "name", "n").groupBy("row").agg(
        F.sum("weight").alias("weight"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") < F.col("n_host"), F.struct("place", "text")))), lambda w: w["text"]), " ").alias("words"),
    )
    rule, action = fitting_rule(rules)
    score = F.coalesce(F.col("weight") + prior, F.lit(0)).cast("long")
    judged = urls.join(told, "row", "left").withColumn("score", score).withColumn("rule", rule)
    verdict = F.coalesce(action, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.coalesce("words", F.lit("")).alias("words"))
