"""Evidence documents (JSON by category) to rows, and the texts of their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.operators.ranking import ranked

# The categories an answer may use as keys.
CATEGORIES = (
    "major_scenes", "dialogue", "character_decisions", "supporting_developments", "relationships", "reveals", "reversals",
    "failures", "consequences", "performance_moments", "setup_payoff", "unresolved", "conflicts", "subplots",
    "strengths_weaknesses", "contradictions", "dilemmas", "visual_storytelling", "recurring_behavior", "power_shifts",
    "reactions", "counter_evidence",
)
PAIRED = ("strengths", "weaknesses")
# Category to item type, fields that hold its point, and the words before it.
POINTS = {
    "reveals": ("reveal", ("reveal",), "Reveal: "), "reversals": ("reversal", ("reversal",), "Reversal: "),
    "consequences": ("consequence", ("consequence",), "Consequence: "), "performance_moments": ("performance_moment", ("description",), "Key moment: "),
    "unresolved": ("unresolved", ("question",), "Unresolved: "), "contradictions": ("contradiction", ("contradiction",), "Contradiction: "),
    "dilemmas": ("dilemma", ("dilemma",), "Dilemma: "), "visual_storytelling": ("visual_storytelling", ("visual", "description"), "Visual: "),
    "recurring_behavior": ("recurring_behavior", ("behavior", "recurring_behavior"), "Behavior: "),
    "power_shifts": ("power_shift", ("power_shift", "shift"), "Power shift: "), "reactions": ("reaction", ("reaction",), "Reaction: "),
    "counter_evidence": ("counter_evidence", ("counter_evidence", "claim"), "Counter evidence: "),
}


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, ... of a variant; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def objects(answers: DataFrame, content: str = "content") -> DataFrame:
    """One row per object of each array in a JSON object: carried columns, key, at, item, names.

    `names` are the item's fields in the order of the document, which VARIANT does not keep; only the lists whose
    items have no sentence of their own need them, for others they are null.
    """
    carried = [c for c in answers.columns if c != content]
    parsed = answers.select(*carried, F.try_variant_get(F.try_parse_json(content), "$", "map<string,variant>").alias("_m"), F.from_json(content, "map<string,string>").alias("_t"))
    text = F.when(F.col("key").isin(*PAIRED), F.from_json(F.try_element_at("_t", F.col("key")), "array<string>"))
    lists = parsed.select(*carried, "_t", F.explode("_m").alias("key", "_v")).withColumn("_t", text)
    rows = lists.select(*carried, "key", "_t", F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("at", "item"))
    return rows.where(kind(F.col("item")) == "OBJECT").withColumn("names", F.json_object_keys(F.get("_t", F.col("at")))).drop("_t")


def route_categories(rows: DataFrame) -> DataFrame:
    """Category of each item: its key, both lists for strengths and weaknesses, the tag of events.

    Other keys are ignored, events marked `exclude` dropped, unknown tags become major scenes.
    """
    known = F.array(*map(F.lit, CATEGORIES + PAIRED))
    tag = F.lower(F.coalesce(F.try_variant_get("item", "$.category", "string"), F.lit("major_scenes")))
    event = F.when(F.array_contains(known, tag), tag).otherwise("major_scenes")
    excluded = F.coalesce(F.try_variant_get("item", "$.exclude", "string"), F.lit("")).isin("", "false", "0")
    routes = (
        F.when(F.col("key").isin(*PAIRED), F.array("key", F.lit("strengths_weaknesses")))
        .when(F.col("key").isin(*CATEGORIES), F.array("key")).when((F.col("key") == "events") & excluded, F.array(event))
    )
    return rows.withColumn("category", F.explode(routes))


def normalise_times(rows: DataFrame) -> DataFrame:
    """start_ms and end_ms of each item: milliseconds before seconds, the chunk where it says nothing.

    Needs chunk_start_ms, chunk_end_ms, duration_ms. Starts are not below 0, ends not before
    starts, and ends more than a second past the duration are cut to it.
    """
    given = lambda a: F.coalesce(
        F.try_variant_get("item", f"$.{a}_ms", "double"), F.try_variant_get("item", f"$.{a}_sec", "double") * 1000, F.col(f"chunk_{a}_ms").cast("double")
    )
    start = F.greatest(F.lit(0.0), given("start"))
    end = F.greatest(start, given("end"))
    over = (F.col("duration_ms") > 0) & (end > F.col("duration_ms") + 1000)
    return rows.withColumns({
        "start_ms": F.bround(start).cast("bigint"), "end_ms": F.bround(F.when(over, F.col("duration_ms").cast("double")).otherwise(end)).cast("bigint"),
    })


# The fields that sentences are made of, read in one cast per item; lists are looked at by kind.
ITEM = (
    "summary string, description string, detail string, speaker string, quote string, character string, decision string, motive string, "
    "development string, dynamic string, reveal string, reversal string, failure string, consequence string, type string, question string, "
    "conflict string, name string, progress string, strength string, weakness string, contradiction string, dilemma string, visual string, "
    "behavior string, recurring_behavior string, power_shift string, shift string, reaction string, counter_evidence string, claim string, "
    "characters variant, parties variant, dialogue_evidence variant"
)


def told(item: Column) -> Column:
    """An item's fields as one struct."""
    return F.try_variant_get(item, "$", f"struct<{ITEM}>")


def people(fields: str) -> Column:
    """Names of an item in order: characters, character, parties, speaker."""
    names = lambda c: F.coalesce(F.try_variant_get(F.col(f"{fields}.{c}"), "$", "array<string>"), F.array().cast("array<string>"))
    one = lambda c: F.array(F.coalesce(F.col(f"{fields}.{c}"), F.lit("")))
    whole = F.concat(names("characters"), one("character"), names("parties"), one("speaker"))
    return F.array_distinct(F.filter(F.transform(whole, F.trim), lambda n: n != ""))


def with_summary(rows: DataFrame) -> DataFrame:
    """Adds `summary`, `characters` and `item_type`: one sentence for an item of its category.

    Fields, shared parts and the sentence are separate steps; each is computed once, behind a
    one-row generator the optimiser does not merge expressions through.
    """
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    rows = once(rows, "_f", told(F.col("item")))
    f = lambda name: F.trim(F.coalesce(F.col(f"_f.{name}"), F.lit("")))
    either = lambda *parts: F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))
    quotes = F.try_variant_get(F.col("_f.dialogue_evidence"), "$", "array<string>")
    spoken = (
        F.when(kind(F.col("_f.dialogue_evidence")) == "ARRAY", F.array_join(F.filter(F.transform(quotes, F.trim), lambda q: q != ""), " "))
        .when(kind(F.col("_f.dialogue_evidence")) == "STRING", F.trim(F.try_variant_get(F.col("_f.dialogue_evidence"), "$", "string"))).otherwise("")
    )
    shared = F.struct(people("_f").alias("names"), either(f("summary"), spoken, f("description"), f("detail")).alias("fallback"))
    rows = once(rows, "_p", shared)
    fallback, names, who = F.col("_p.fallback"), F.col("_p.names"), f("character")
    if_any = lambda point, sentence: F.when(point != "", sentence).otherwise("")
    said = lambda *fields: either(*[f(x) for x in fields], fallback)
    named = lambda word: F.when(F.size(names) > 0, F.concat(F.lit(f"{word} ("), F.array_join(names, ", "), F.lit("): "))).otherwise(f"{word}: ")
    after = lambda test, prefix, other: F.when(test != "", prefix).otherwise(other)
    quote, decided, motive = said("quote"), said("decision"), f("motive")
    stage = F.trim(F.coalesce(F.col("_f.type"), F.lit("setup")))
    traits = F.filter(
        F.array(*[F.when(f(x) != "", F.concat(F.lit(f"{x}: "), f(x))) for x in ("strength", "weakness")]), lambda p: p.isNotNull()
    )
    trait = F.when(F.size(traits) > 0, F.array_join(traits, ", ")).otherwise(fallback)
    rules = {
        "major_scenes": (F.lit("scene"), fallback),
        "dialogue": (F.lit("dialogue"), F.when(f("speaker") != "", F.concat(f("speaker"), F.lit(': "'), quote, F.lit('"'))).otherwise(if_any(quote, F.concat(F.lit('"'), quote, F.lit('"'))))),
        "character_decisions": (F.lit("decision"), if_any(decided, F.concat(
            after(who, F.concat(who, F.lit(" decides: ")), "Decision: "), decided, after(motive, F.concat(F.lit(" (motive: "), motive, F.lit(")")), "")))),
        "supporting_developments": (F.lit("supporting_development"), if_any(said("development"), F.concat(after(who, F.concat(who, F.lit(": ")), ""), said("development")))),
        "relationships": (F.lit("relationship"), if_any(said("dynamic"), F.concat(named("Relationship"), said("dynamic")))),
        "failures": (F.lit("failure"), if_any(said("failure"), F.concat(after(who, F.concat(who, F.lit(" failure: ")), "Failure: "), said("failure")))),
        "setup_payoff": (F.when(stage != "", F.lower(stage)).otherwise("setup"), if_any(said("detail"), F.concat(F.initcap(stage), F.lit(": "), said("detail")))),
        "conflicts": (F.lit("conflict"), if_any(said("conflict"), F.concat(named("Conflict"), said("conflict")))),
        "subplots": (F.lit("subplot"), if_any(said("progress"), F.concat(after(f("name"), F.concat(F.lit("Subplot '"), f("name"), F.lit("': ")), "Subplot: "), said("progress")))),
        "strengths_weaknesses": (F.lit("trait"), if_any(trait, after(who, F.concat(who, F.lit(" ("), trait, F.lit(")")), trait))),
    }
    for name, (item_type, fields, words) in POINTS.items():
        # A second field stands in only where the first is absent, not where it is empty.
        point = either(F.trim(F.coalesce(*[F.col(f"_f.{x}") for x in fields])), fallback)
        rules[name] = (F.lit(item_type), if_any(point, F.concat(F.lit(words), point)))
    # Any other category: all its texts, in the order of the document where that is known, else in key order.
    values = F.coalesce(F.try_variant_get("item", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    order = F.coalesce(F.col("names"), F.map_keys(values)) if "names" in rows.columns else F.map_keys(values)
    words = lambda v: F.when(kind(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string")))
    texts = F.filter(
        F.transform(F.filter(order, lambda k: ~k.isin("episode_id", "item_type")), lambda k: words(F.try_element_at(values, k))), lambda t: t.isNotNull() & (t != "")
    )
    category = F.col("category")
    pair = lambda item_type, sentence: F.struct(item_type.alias("item_type"), sentence.alias("sentence"))
    chosen = None
    for name, (item_type, sentence) in rules.items():
        chosen = F.when(category == name, pair(item_type, sentence)) if chosen is None else chosen.when(category == name, pair(item_type, sentence))
    chosen = chosen.otherwise(pair(category, either(F.array_join(texts, "; "), fallback, F.concat(category, F.lit(" event")))))
    rows = once(rows, "_s", chosen)
    told_ = F.trim(F.when(F.trim("_s.sentence") == "", fallback).otherwise(F.col("_s.sentence")))
    return rows.withColumns({"summary": told_, "characters": names, "item_type": F.col("_s.item_type")}).drop("_f", "_p", "_s")


def summary_items(evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """Summary rows of evidence items: seconds before milliseconds, five seconds where no end is given.

    evidence: episode_id, category, idx, item (variant). Items without any text are dropped.
    """
    given = lambda a: F.coalesce(F.try_variant_get("item", f"$.{a}_sec", "double") * 1000, F.try_variant_get("item", f"$.{a}_ms", "double"))
    start = F.greatest(F.lit(0.0), F.coalesce(given("start"), F.lit(0.0)))
    end = F.when(given("end").isNull(), start + 5000).otherwise(F.greatest(start, given("end")))
    timed = evidence.join(episodes.select("episode_id", "duration_ms"), "episode_id")
    cut = F.when(F.col("duration_ms") > 0, F.least(end, F.col("duration_ms").cast("double"))).otherwise(end)
    rows = timed.withColumns({"start_ms": F.bround(start).cast("bigint"), "end_ms": F.bround(cut).cast("bigint")})
    return with_summary(rows).where("summary <> ''").select(
        "episode_id", "category", F.concat("category", F.lit(":"), "idx").alias("ref"), "start_ms", "end_ms", "summary", "characters", "item_type"
    )


def answer_evidence(answers: DataFrame) -> DataFrame:
    """Evidence rows of scan answers: routed, timed, and numbered from 0 per (episode, category) as `idx`.

    answers: episode_id, chunk_index, chunk_start_ms, chunk_end_ms, duration_ms, content. Items stand in the order of their
    chunks; within one, those of the category's own list come first, then strengths, weaknesses, and events. A season is
    numbered in ranges, so no task holds an episode. A `project` column, where there is one, is part of the key.
    """
    rows = normalise_times(route_categories(objects(answers)))
    source = F.when(F.col("key") == F.col("category"), 0).when(F.col("key") == "strengths", 1).when(F.col("key") == "weaknesses", 2).otherwise(3)
    keys = [*[c for c in ("project",) if c in rows.columns], "episode_id", "category"]
    numbered = ranked(rows.withColumn("_source", source), keys, ["chunk_index", "_source", "at"], "_n")
    return numbered.withColumn("idx", F.col("_n") - 1).drop("_n", "_source")


def offline_evidence(cues: DataFrame) -> DataFrame:
    """Without a model: every cue is a dialogue item of at most 200 characters, and nobody is named."""
    return cues.select(
        "episode_id", F.lit("dialogue").alias("category"), F.col("ordinal").alias("idx"), "start_ms", "end_ms",
        F.substring("text", 1, 200).alias("summary"), F.array("text").alias("dialogue_evidence"), F.array().cast("array<string>").alias("characters"),
    )
