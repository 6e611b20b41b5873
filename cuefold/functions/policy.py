"""Editorial prompts split in clauses and routed to the stage they speak to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Objective categories, the evidence category each maps to, and how a clause names it.
OBJECTIVES = (
    ("major_scene", "major_scenes", r"\b(major[\s_-]?scenes?)\b"),
    ("conflict", "conflicts", r"\b(conflicts?)\b"),
    ("confrontation", "conflicts", r"\b(confrontations?)\b"),
    ("important_dialogue", "dialogue", r"\b((important|significant|key)[\s_-]?dialogues?|quotes?)\b"),
    ("character_decision", "character_decisions", r"\b(character[\s_-]?decisions?|pivotal[\s_-]?choices?)\b"),
    ("supporting_development", "supporting_developments", r"\b(supporting[\s_-]?(character|development)s?|secondary[\s_-]?characters?)\b"),
    ("relationship_change", "relationships", r"\b(relationship[\s_-]?(changes?|dynamics?)|alliances?|rivalr(y|ies))\b"),
    ("reveal", "reveals", r"\b(reveals?|revelations?|secrets?[\s_-]?exposed)\b"),
    ("reversal", "reversals", r"\b(reversals?|plot[\s_-]?twists?)\b"),
    ("failed_plan", "failures", r"\b(failed[\s_-]?plans?|fallen[\s_-]?plans?|tactical[\s_-]?blunders?|failures?)\b"),
    ("consequence", "consequences", r"\b(consequences?|fallout)\b"),
    ("performance", "performance_moments", r"\b(performance[\s_-]?moments?|standout[\s_-]?interactions?|dramatic[\s_-]?scenes?)\b"),
    ("setup", "setup_payoff", r"\b(setups?|narrative[\s_-]?plants?|foreshadowing)\b"),
    ("payoff", "setup_payoff", r"\b(payoffs?)\b"),
    ("unresolved", "unresolved", r"\b(unresolved|cliffhangers?|lingering[\s_-]?questions?|mysteries)\b"),
    ("contradiction", "conflicts", r"\b(contradictions?|inconsistenc(y|ies))\b"),
    ("moral/strategic dilemma", "character_decisions", r"\b(moral[\s_-]?(and|or|/)?[\s_-]?strategic[\s_-]?dilemmas?|dilemmas?)\b"),
    ("visual_storytelling", "major_scenes", r"\b(visual[\s_-]?storytelling|visual[\s_-]?cues?|visual[\s_-]?details?)\b"),
    ("recurring behavior", "supporting_developments", r"\b(recurring[\s_-]?behaviors?|habits?|patterns?[\s_-]?of[\s_-]?behavior)\b"),
    ("subplot", "subplots", r"\b(subplots?|secondary[\s_-]?storylines?)\b"),
    ("power_shift", "relationships", r"\b(power[\s_-]?shifts?|shifts?[\s_-]?in[\s_-]?power)\b"),
    ("reaction", "performance_moments", r"\b(reactions?|emotional[\s_-]?reactions?)\b"),
    ("strength/weakness", "strengths_weaknesses", r"\b(strengths?[\s_-]?(and|or|/)?[\s_-]?weakness(es)?|vulnerabilit(y|ies))\b"),
    ("counter_evidence", "conflicts", r"\b(counter[\s_-]?evidence|counter[\s_-]?claims?)\b"),
)

# What each route listens for.
PUBLISHING = (
    r"(\.(mp3|wav|aac|flac|ogg|m4a)\b|"
    r"\b(background[\s_-]?music|bgm|audio[\s_-]?(file|track|gain|volume|mix)|"
    r"commentary[\s_-]?gain|auto[\s_-]?duck|ducking|loudness|lufs|true[\s_-]?peak|"
    r"voice[\s_-]?id|tts|dubbing|voiceover|narration[\s_-]?voice|speech[\s_-]?synthesis)\b|"
    r"\b(mute[\s_-]?audio|duck[\s_-]?audio|keep[\s_-]?audio|original[\s_-]?only)\b|"
    r"\.(srt|vtt|ass)\b|\b(export[\s_-]?srt|generate[\s_-]?srt|burn[\s_-]?subtitles|subtitle[\s_-]?files?)\b|"
    r"\.(mp4|mkv|mov|avi|webm)\b|\b(\d+p\b|\d+fps\b|bitrates?|codecs?|h\.?264|hevc|"
    r"render[\s_-]?(queue|settings|video|output)|output[\s_-]?(dir|directory))\b|"
    r"\b(youtube|tiktok|instagram|facebook|vimeo|channel[\s_-]?names?|video[\s_-]?tags|"
    r"seo[\s_-]?descriptions?|upload[\s_-]?to|publish[\s_-]?to)\b|"
    r"\b(narration[\s_-]?scripts?|final[\s_-]?commentary|script[\s_-]?format|"
    r"target[\s_-]?duration|recap[\s_-]?length|recap[\s_-]?language|recap[\s_-]?mode|voice[\s_-]?style)\b)"
)
AUDIO = r"(\.(mp3|wav|aac|flac|ogg|m4a)\b|audio|music|duck|mute|gain|voice|tts|loudness|lufs)"
FILES = r"(\.(srt|vtt|ass)\b|subtitle)|(\.(mp4|mkv|mov|avi|webm)\b|render|\d+p|\d+fps|bitrate|codec|output_dir)"
VALIDATION = r"\b(hallucinat\w*|strict(ly)?[\s_-]?within|timestamps?|grounded|fact[\s_-]?check\w*|no[\s_-]?invent\w*)\b"
COVERAGE = (
    r"\b(episodes?(\s+\d+)+|season[\s_-]?coverage|all[\s_-]?episodes|skip[\s_-]?episodes?|"
    r"only[\s_-]?episodes?|missing[\s_-]?episodes?|exclude[\s_-]?episodes?|min[\s_-]?episodes?|max[\s_-]?episodes?)\b"
)
CONNECTION = (
    r"\b(cross[\s_-]?episodes?|season[\s_-]?wide|overarching|causal[\s_-]?threads?|"
    r"connect(ion)?s?[\s_-]?across[\s_-]?episodes|batch[\s_-]?connections?|thread[\s_-]?id)\b"
)
CANDIDATE = (
    r"\b(candidates?(\s+proposals?)?|single[\s_-]?scene|single[\s_-]?episode|season[\s_-]?arc|"
    r"strong[\s_-]?keep|weak[\s_-]?reject|duplicate[\s_-]?merge|quotas?|proposal[\s_-]?id)\b"
)
EVIDENCE = (
    r"\b(evidence|dialogues?|scenes?|transcripts?|quotes?|clues?|actions?|story[\s_-]?beats?|"
    r"characters?|events?|motives?|timeline)\b"
)
OUTPUT = r"\b(output|script|commentary|narrator|tone|style|audience|summary|pacing|presentation)\b"


def normalise_prompt(prompt: Column) -> Column:
    """Unix line ends, no blanks at line ends, none around."""
    t = F.regexp_replace(F.regexp_replace(prompt, r"\r\n|\r", "\n"), r"[^\S\n]+(?=\n|$)", "")
    return F.coalesce(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def prompt_clauses(prompts: DataFrame, key: str, prompt: str = "prompt") -> DataFrame:
    """(key, position, clause): lines without list marks, cut after sentence ends; '#' lines are remarks."""
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(normalise_prompt(F.col(prompt)), "\n"), strip), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    bare = F.filter(F.transform(lines, lambda s: strip(F.regexp_replace(s, r"^[\s*\->#\d.)]+", ""))), lambda s: s != "")
    parts = F.flatten(F.transform(bare, lambda s: F.split(s, r"(?<=[.!?;])\s+")))
    clean = F.filter(F.transform(parts, strip), lambda s: s != "")
    return prompts.select(key, F.posexplode(clean).alias("position", "clause"))


def route_clauses(clauses: DataFrame) -> DataFrame:
    """Adds `routes` (array), `objectives` and `schema_categories` to each clause.

    The first of publishing, validation and coverage that fits takes the clause alone; connection
    and candidate add up and may still feed the scanner; a clause that fits nothing speaks to the
    scanner and to the editors.
    """
    says = lambda pattern: F.col("clause").rlike("(?i)" + pattern)
    publishing = F.when(says(AUDIO), "audio").when(says(FILES), "file").otherwise("output")
    hits = F.filter(
        F.array(*[F.when(says(p), F.struct(F.lit(o).alias("objective"), F.lit(c).alias("category"))) for o, c, p in OBJECTIVES]), lambda h: h.isNotNull()
    )
    some = F.size("_hits") > 0
    linked, proposed = says(CONNECTION), says(CANDIDATE)
    special = linked | proposed
    scanner = some | says(EVIDENCE)
    stray = ~scanner & ~special & ~says(OUTPUT)
    additive = F.array(
        F.when(linked, F.lit("connection")), F.when(proposed, F.lit("candidate")), F.when(scanner | stray, F.lit("scanner")),
        F.when((scanner & ~special) | stray, F.lit("editorial")), F.when(~scanner & ~special & says(OUTPUT), F.lit("output")),
    )
    routes = (
        F.when(says(PUBLISHING), F.array(publishing)).when(says(VALIDATION), F.array(F.lit("validation")))
        .when(says(COVERAGE), F.array(F.lit("coverage"))).otherwise(F.filter(additive, lambda r: r.isNotNull()))
    )
    routed = clauses.withColumn("_hits", hits).withColumn("routes", routes)
    told = F.array_contains("routes", "scanner") & some
    pick = lambda field: F.when(told, F.array_distinct(F.transform("_hits", lambda h: h[field]))).otherwise(F.array().cast("array<string>"))
    return routed.withColumns({"objectives": pick("objective"), "schema_categories": pick("category")}).drop("_hits")


def capped_directive(clauses: DataFrame, key: str, max_bytes: int = 4096, header: str = "") -> DataFrame:
    """One text per key of the longest run of leading clauses that fits `max_bytes`.

    Clauses of a prompt are few, so their running size is a window per prompt; a first clause that
    does not fit is cut to the room left.
    """
    line = F.octet_length("clause") + 3
    ordered = Window.partitionBy(key).orderBy("position")
    sized = clauses.withColumns({"_to": F.sum(line).over(ordered) + F.lit(len(header.encode()) - 1), "_rank": F.row_number().over(ordered)})
    kept = sized.where((F.col("_to") <= max_bytes) | (F.col("_rank") == 1))
    text = F.expr("listagg(concat('- ', clause), '\n') WITHIN GROUP (ORDER BY position)")
    whole = kept.groupBy(key).agg(F.concat(F.lit(header), text).alias("directive"))
    return whole.withColumn("directive", byte_prefix(F.col("directive"), max_bytes))


def byte_prefix(text: Column, max_bytes: int) -> Column:
    """Longest prefix of whole characters within `max_bytes` of UTF-8."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"))
    step = lambda s, c: F.struct(
        (s["used"] + F.octet_length(c)).alias("used"), F.when(s["used"] + F.octet_length(c) <= max_bytes, s["kept"] + 1).otherwise(s["kept"]).alias("kept")
    )
    kept = F.aggregate(F.split(text, ""), start, step, lambda s: s["kept"])
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.substr(text, F.lit(1), kept))
