"""Candidate similarity: scores, the links that matter, and the groups they form.

score = 0.40 J(thesis) + 0.25 J(tags) + 0.20 J(refs) + 0.15 J(characters), lifted to 0.70 / 0.55 /
0.50 for candidates of the same primary character (thesis J >= .35 / shared episode and thesis
J >= .20 / tags J >= .30) and to 0.65 by any shared reference. Pairs of at least 0.25 are linked.

Scoring all pairs is quadratic, and so is listing all pairs of a popular tag or of a family of
copies. Groups need only links that keep the components, so:

1. *Hub links.* A shared reference, an equal tag set or an equal thesis reaches the threshold
   alone. All holders of one are joined by linking each to the smallest id, a map-side combined
   minimum, linear in the rows whatever the size of the group.
2. *Cross links.* What is left are pairs of different hub groups. Each way to reach the
   threshold without a hub gives an exact block: the words a thesis must share (prefix filter
   in order of rarity), alone or together with the character, tag, episode or primary character that
   lowers the needed overlap. Every pair has a row outside the project's largest hub group, so the
   rows of that group are only put in blocks that hold one from outside; they use all their words, which
   needs no ranks. A block whose rows are all of one hub group is dropped, and in
   the others only rows outside the block's largest hub group look for partners, in tiles of `TILE` of
   them. Two rows that meet at a word go on only if what is left of both theses from there allows the overlap.

`candidate_groups` may take the holders of a tag under one primary character as a hub group, too; `similar_links` lists
their links to the smallest id and does not spare their pairs for it, since they are links between different texts.

A candidate's project, where there is one, is part of its id: nothing meets across projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.functions.text import jaccard, tokens
from cuefold.operators.graph import connected_components
from cuefold.session import durable, spread

THRESHOLD = 0.25
W_THESIS, W_TAGS, W_REFS, W_CHARS = 0.40, 0.25, 0.20, 0.15
#: Thesis overlaps that suffice under one primary character, in any and in a shared episode; tag overlap that does.
SAME, SAME_NEAR, SAME_TAGS = 0.35, 0.20, 0.30
#: Rows of a block that look for partners in one task.
TILE = 2_000
SEPARATOR = "\x1f"


def _clean(values: str) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def features(candidates: DataFrame) -> DataFrame:
    """id, project, words, tags, refs, chars, primary, eps of each candidate; arrays are distinct.

    `marks` are the words as 64-bit hashes, for screening pairs without moving their texts. The id leads with the project.
    """
    words = tokens(F.concat_ws(" ", "title", "thesis", "subject"))
    held = F.filter(F.transform("ranges", lambda r: r["ref"]), lambda r: r.isNotNull() & (r != ""))
    project = F.coalesce(F.col("project"), F.lit("")) if "project" in candidates.columns else F.lit("")
    worded = candidates.withColumn("words", words)
    return worded.select(
        F.concat(project, F.lit(SEPARATOR), F.col("proposal_id")).alias("id"), project.alias("project"),
        "words", F.transform("words", lambda w: F.xxhash64(w)).alias("marks"), _clean("tags").alias("tags"),
        F.array_union("refs", F.coalesce(held, F.array().cast("array<string>"))).alias("refs"), _clean("characters").alias("chars"),
        F.lower(F.trim(F.coalesce("primary_character", F.lit("")))).alias("primary"), F.array_distinct("episodes").alias("eps"),
    )


def _own_id(column: str) -> Column:
    """The candidate's own id, without its project."""
    return F.substring_index(column, SEPARATOR, -1)


def _project(column: str) -> Column:
    return F.substring_index(column, SEPARATOR, 1)


def score_pairs(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """(a, b, score) for the given id pairs. Each overlap is counted once, then scored."""
    held = feats.select("id", F.struct("words", "tags", "refs", "chars", "primary", "eps").alias("f"))
    met = pairs.join(held.select(F.col("id").alias("a"), F.col("f").alias("l")), "a").join(
        held.select(F.col("id").alias("b"), F.col("f").alias("r")), "b"
    )
    shared = lambda c: F.size(F.array_intersect(f"l.{c}", f"r.{c}"))
    size = lambda c: (F.size(f"l.{c}") + F.size(f"r.{c}")).alias(f"{c}_n")
    counted = met.select(
        "a", "b", *[shared(c).alias(c) for c in ("words", "tags", "refs", "chars")], *[size(c) for c in ("words", "tags", "refs", "chars")],
        ((F.col("l.primary") != "") & (F.col("l.primary") == F.col("r.primary"))).alias("same"), F.arrays_overlap("l.eps", "r.eps").alias("near"),
    )
    j = {c: F.when(F.col(f"{c}_n") > 0, F.col(c) / (F.col(f"{c}_n") - F.col(c))).otherwise(F.lit(0.0)) for c in ("words", "tags", "refs", "chars")}
    base = j["words"] * W_THESIS + j["tags"] * W_TAGS + j["refs"] * W_REFS + j["chars"] * W_CHARS
    same, near = F.col("same"), F.col("near")
    lift = F.when(same & (j["words"] >= SAME), 0.70).when(same & near & (j["words"] >= SAME_NEAR), 0.55).when(same & (j["tags"] >= SAME_TAGS), 0.50).otherwise(0.0)
    proof = F.when(F.col("refs") > 0, 0.65).otherwise(0.0)
    return counted.select("a", "b", F.least(F.lit(1.0), F.greatest(base, lift, proof)).alias("score"))


def _may_reach(words: Column, threshold: float) -> Column:
    """Whether a pair without shared references can reach the threshold with `words` shared words."""
    jw = F.when(F.col("n") > 0, words / (F.col("n") - words)).otherwise(F.lit(0.0))
    base = jw * W_THESIS + F.col("jt") * W_TAGS + F.col("jc") * W_CHARS
    lift = F.when(jw >= SAME, 0.70).when(F.col("near") & (jw >= SAME_NEAR), 0.55).when(F.col("jt") >= SAME_TAGS, 0.50).otherwise(0.0)
    return F.greatest(base, F.when(F.col("same"), lift).otherwise(0.0)) >= threshold - 1e-9


def screen_pairs(pairs: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that may reach the threshold; none that does is lost.

    Short features and thesis sizes go first (no more words can be shared than the shorter thesis
    has), then hashed words. Two are added to a hashed overlap, since two words of a thesis may
    share a hash; what passes is scored on its texts. The pairs share no reference.
    """
    small = feats.select("id", F.struct(F.size("words").alias("w"), "tags", "chars", "primary", "eps").alias("f"))
    # A pair is a few bytes but costs an intersection of two theses.
    met = spread(pairs, "a", "b").join(small.select(F.col("id").alias("a"), F.col("f").alias("l")), "a").join(small.select(F.col("id").alias("b"), F.col("f").alias("r")), "b")
    known = F.struct(
        (F.col("l.w") + F.col("r.w")).alias("n"), F.least("l.w", "r.w").alias("most"), jaccard(F.col("l.tags"), F.col("r.tags")).alias("jt"),
        jaccard(F.col("l.chars"), F.col("r.chars")).alias("jc"), ((F.col("l.primary") != "") & (F.col("l.primary") == F.col("r.primary"))).alias("same"),
        F.arrays_overlap("l.eps", "r.eps").alias("near"),
    )
    sized = met.select("a", "b", F.explode(F.array(known)).alias("k")).select("a", "b", "k.*").where(_may_reach(F.col("most"), threshold))
    held = feats.select("id", "marks")
    hashed = sized.join(held.select(F.col("id").alias("a"), F.col("marks").alias("l")), "a").join(held.select(F.col("id").alias("b"), F.col("marks").alias("r")), "b")
    # A one-row generator keeps the intersection from being copied into each use in the filter.
    shared = F.explode(F.array(F.least(F.size(F.array_intersect("l", "r")) + 2, F.col("most"))))
    return hashed.select("a", "b", "n", "jt", "jc", "same", "near", shared.alias("shared")).where(_may_reach(F.col("shared"), threshold)).select("a", "b")


def hub_links(feats: DataFrame, told: bool = False) -> DataFrame:
    """(a, b): each candidate linked to the smallest id that shares a deciding feature with it.

    With `told`, a tag under one primary character decides too, if neither has more than two tags.
    """
    mark = lambda rows, kind, value: rows.select("id", F.xxhash64(F.lit(kind), "project", value).alias("k"), F.sha2(F.concat_ws("\x01", "project", value), 256).alias("k2"))
    whole = lambda kind, column: mark(feats.where(F.size(column) > 0), kind, F.array_join(F.array_sort(column), "\x02"))
    refs = mark(feats.select("id", "project", F.explode("refs").alias("v")), "ref", F.col("v"))
    marks = refs.unionByName(whole("tags", "tags")).unionByName(whole("words", "words"))
    # One of at most three tags together is shared: an overlap of a third at least.
    tagged = feats.where((F.col("primary") != "") & (F.size("tags") <= 2)).select("id", "project", "primary", F.explode("tags").alias("t"))
    marks = marks.unionByName(mark(tagged, "told", F.concat_ws("\x02", "primary", "t"))) if told else marks
    hubs = marks.groupBy("k", "k2").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        marks.join(hubs, ["k", "k2"]).where("id <> hub")
        .select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    )


def _needed(size: Column, overlap: Column | float) -> Column:
    """How many of the rarest of `size` words may hold the first shared one at this Jaccard."""
    return size - F.ceil(size * F.lit(overlap) if not isinstance(overlap, Column) else size * overlap) + 1


def rare_first(seekers: DataFrame, feats: DataFrame) -> DataFrame:
    """(id, word, rank, size): words of each seeker's thesis, those that are rarest among all `feats` first.

    Document frequencies are a map-side combined count of the seekers' words; ranks are taken per candidate.
    """
    words = durable(seekers.select("id", F.size("words").alias("size"), F.explode("words").alias("word")))
    asked = durable(words.select("word").distinct())
    often = feats.select(F.explode("words").alias("word")).join(asked, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return words.join(often, "word").select(
        "id", "word", "size", F.row_number().over(Window.partitionBy("id").orderBy("df", "word")).alias("rank")
    )


def _blocks(feats: DataFrame, worded: DataFrame) -> DataFrame:
    """(k, id, size, rank, need, tags): every block in which a pair over the threshold without a hub must meet.

    worded: the columns of `feats` with word, rank and size, a row a word. Where a block is of a word, size and rank are the
    thesis's and the word's in it and `need` is the overlap that the pair must have; where it depends on the tags, their
    number. Block names are hashed to 64 bits; two names that collide only add pairs to verify. Words without a rank are all in.
    """
    none, of = F.lit(None), F.size("tags")
    within = lambda overlap: F.col("rank").isNull() | (F.col("rank") <= _needed(F.col("size"), overlap))
    key = lambda kind, *names, need=none, tags=none: F.struct(
        F.xxhash64(F.lit(kind), "project", *names).alias("k"), need.cast("double").alias("need"), tags.cast("int").alias("tags")
    )
    when = lambda test, keys: F.when(test, keys).otherwise(F.array().cast("array<struct<k:bigint,need:double,tags:int>>"))
    low, led = (THRESHOLD - W_CHARS) / W_THESIS, F.col("primary") != ""
    by_word = F.concat(
        # The thesis alone: 0.25 / 0.40. With a shared character: (0.25 - 0.15) / 0.40.
        when(within(THRESHOLD / W_THESIS), F.array(key("w", "word", need=F.lit(THRESHOLD / W_THESIS)))),
        when(within(low), F.transform("chars", lambda c: key("c", c, "word", need=F.lit(low)))),
        # Same primary character: a thesis overlap that does in any episode, or less in a shared one.
        when(led & within(SAME), F.array(key("p", "primary", "word", need=F.lit(SAME)))),
        when(led & within(SAME_NEAR), F.transform("eps", lambda e: key("e", "primary", e, "word", need=F.lit(SAME_NEAR)))),
        # With a shared tag among n: unequal tag sets have J of at most n / (n + 1).
        when(within(THRESHOLD / W_THESIS / (of + 1)), F.transform("tags", lambda t: key("t", t, "word", tags=of))),
    )
    # Tags with the primary character, or with another shared character, may do without words.
    by_tag = F.concat(
        when(led, F.transform("tags", lambda t: key("pt", "primary", t))),
        F.flatten(F.transform("tags", lambda t: F.transform("chars", lambda c: key("tc", t, c)))),
    )
    columns = ["k.k", "id", F.col("size").cast("int").alias("size"), F.col("rank").cast("int").alias("rank"), "k.need", "k.tags"]
    bare = feats.select("id", none.alias("size"), none.alias("rank"), F.explode(by_tag).alias("k")).select(*columns)
    return worded.select("id", "size", "rank", F.explode(by_word).alias("k")).select(*columns).unionByName(bare)


def _may_overlap() -> Column:
    """Whether two rows that meet at a word of theirs may have the overlap they need.

    Words come in one order everywhere. Of a pair's shared words the first is the one that counts here: up to it nothing is
    shared, so what is shared is no more than that word and the rest of the shorter remainder. A word without a rank may be the first.
    """
    n, m = F.col("l.tags"), F.col("r.tags")
    shared = F.when(n == m, n - 1).otherwise(F.least(n, m))
    by_tags = (THRESHOLD - W_TAGS * shared / (n + m - shared)) / W_THESIS
    need = F.coalesce("l.need", by_tags)
    left = lambda side: F.col(f"{side}.size") - F.coalesce(F.col(f"{side}.rank"), F.lit(1))
    possible = 1 + F.least(left("l"), left("r"))
    return F.coalesce(possible >= need / (1 + need) * (F.col("l.size") + F.col("r.size")) - 1e-6, F.lit(True))


def cross_links(feats: DataFrame, hub_groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score): linked pairs of different hub groups.

    hub_groups: id, group.
    """
    held = feats.select("id", "project", "words", "primary", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tags", "chars", "eps")])
    sizes = hub_groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    largest = durable(sizes.groupBy(_project("group")).agg(F.max_by("group", F.struct("n", "group")).alias("group")))
    # A pair of different groups has a row outside the project's largest: the others go only where such a row is.
    outside = durable(held.join(hub_groups.join(largest, "group", "left_anti").select("id"), "id", "left_semi"))
    inside = held.join(hub_groups.join(largest, "group", "left_semi").select("id"), "id", "left_semi")
    asking = durable(_blocks(outside, outside.join(rare_first(outside, feats), "id")))
    asked = durable(asking.select("k").distinct())
    # What shares no character, tag or primary character with a row outside can only meet one by words alone.
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    names = F.explode(F.concat(F.array(F.concat(F.lit("p"), "primary")), named("c", "chars"), named("t", "tags")))
    attributes = durable(outside.select("project", names.alias("v")).distinct())
    near = inside.select("id", "project", names.alias("v")).join(attributes, ["project", "v"], "left_semi").select("id").distinct().withColumn("_near", F.lit(True))
    kept = lambda c, empty: F.when(F.col("_near"), F.col(c)).otherwise(empty).alias(c)
    none = F.array().cast("array<string>")
    rows = inside.join(near, "id", "left").select("id", "project", "words", kept("primary", F.lit("")), *[kept(c, none) for c in ("tags", "chars", "eps")])
    # Keys are few bytes but many a row.
    rows = spread(rows, "id")
    unranked = rows.select("*", F.explode("words").alias("word"), F.size("words").alias("size"), F.lit(None).cast("int").alias("rank"))
    asked_for = durable(_blocks(rows, unranked).join(asked, "k", "left_semi"))
    marked = asking.unionByName(asked_for).join(hub_groups, "id")
    mixed = marked.groupBy("k").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("k")
    live = durable(marked.join(mixed, "k", "left_semi"))
    counts = live.groupBy("k", "group").agg(F.count(F.lit(1)).alias("n"))
    # Every pair of different groups has a row outside the largest one: only those seek partners.
    main = counts.groupBy("k").agg(F.max_by("group", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    tiles = F.ceil((F.col("all") - F.col("most")) / TILE).cast("int")
    told = live.join(main.select("k", "main", tiles.alias("tiles")), "k")
    seekers = told.where(F.col("group") != F.col("main")).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).alias("l")
    others = told.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("r")
    apart = (F.col("l.group") != F.col("r.group")) & ((F.col("r.group") == F.col("r.main")) | (F.col("l.id") < F.col("r.id")))
    met = seekers.join(others, (F.col("l.k") == F.col("r.k")) & (F.col("l.tile") == F.col("r.tile")) & apart & _may_overlap())
    pairs = met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    likely = durable(screen_pairs(pairs, feats, threshold))
    return score_pairs(likely, feats).where(F.col("score") >= threshold)


def similar_links(candidates: DataFrame) -> DataFrame:
    """(project, a, b, score): hub links and cross links, which have the components of all linked pairs.

    Holders of a tag under one primary character are linked to their smallest id, and to each other where nothing else makes them one group.
    """
    feats = durable(features(candidates))
    hubs, told = durable(hub_links(feats)), durable(hub_links(feats, True))
    groups = durable(connected_components(feats, hubs))
    across = cross_links(feats, groups).join(told, ["a", "b"], "left_anti")
    links = score_pairs(told, feats).unionByName(across)
    return links.select(_project("a").alias("project"), _own_id("a").alias("a"), _own_id("b").alias("b"), "score")


def candidate_groups(candidates: DataFrame) -> DataFrame:
    """(project, proposal_id, group_id): candidates with the smallest id of their group; singletons stay."""
    feats = durable(features(candidates))
    hubs = durable(hub_links(feats, True))
    groups = durable(connected_components(feats, hubs))
    across = cross_links(feats, groups)
    # Cross links join hub groups, so the second pass runs on the groups.
    left, right = groups.select(F.col("id").alias("a"), F.col("group").alias("ga")), groups.select(F.col("id").alias("b"), F.col("group").alias("gb"))
    lifted = across.join(left, "a").join(right, "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
    top = connected_components(groups.select(F.col("group").alias("id")).distinct(), lifted).select(F.col("group").alias("top"), F.col("id").alias("group"))
    return groups.join(top, "group").select(_project("id").alias("project"), _own_id("id").alias("proposal_id"), _own_id("top").alias("group_id"))
