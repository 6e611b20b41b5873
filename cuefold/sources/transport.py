"""Columnar text transport of evidence: a string dictionary per project, masks and back references.

A document is one JSON object per (project, episode) of category to value, of any nesting. It is shredded to
units: an object in a category's list is a `row`, any other member of a list a `literal`, a value that is no list a `scalar`, and
an `empty` list or a document of `none` keeps a unit too, so nothing is lost. A row is its presence mask, of any width, the mask of
derived fields, and the remaining values in column order, with '^' and a column number for a value told before.
Strings worth it, at any depth, are replaced by '~' and their number in the project's dictionary; others that begin with one of
the marks double it. It is a text for one request; at rest, Parquet's own encodings do this.

What one row says about itself is found by array functions where it stands; JSON texts are taken apart to pieces (strings, keys, the rest)
in their unit's row; a dictionary is a table joined on the strings a unit holds, each once. Columns of a category come in name order, numbers as VARIANT writes them. Project,
episode and category are not null; content that is no JSON object fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.operators.ranking import ranked
from cuefold.session import durable

DOC = ["project", "episode_id"]
UNIT = [*DOC, "category", "idx"]
# A string with the colon that makes it a key, or what stands between strings.
PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+":?|[^"]++'
# A reference to the dictionary.
REF = r'^"~([0-9a-z]+)"$'
# Bytes of the shortest string in the dictionary.
LEAST = 8
WORD_BITS = 60
WORD_DIGITS = WORD_BITS // 4


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once per row: the optimiser does not merge expressions through the generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def _whole(parts: Column, sep: str, around: str) -> Column:
    return F.concat(F.lit(around[0]), F.array_join(parts, sep), F.lit(around[1]))


def hex_mask(cols: Column) -> Column:
    """The number whose bits are the columns, of any width, as hexadecimal digits: summed in words of 60 bits."""
    size = F.lit(WORD_BITS)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (c % size).cast("int"))
    word = lambda w: F.aggregate(F.filter(cols, lambda c: F.floor(c / size) == w), F.lit(0).cast("bigint"), lambda s, c: s + bit(c))
    last = F.coalesce(F.floor(F.array_max(cols) / size), F.lit(0)).cast("int")
    digits = F.transform(F.sequence(last, F.lit(0), F.lit(-1)), lambda w: F.lpad(F.lower(F.hex(word(w))), WORD_DIGITS, "0"))
    return F.regexp_replace(F.array_join(digits, ""), "^0+(?=.)", "")


def mask_bits(mask: Column) -> Column:
    """The columns of a mask, in order."""
    count = F.ceil(F.length(mask) / WORD_DIGITS).cast("int")
    padded = F.lpad(mask, count * WORD_DIGITS, F.lit("0"))
    word = lambda w: F.conv(F.substr(padded, (count - 1 - w) * WORD_DIGITS + 1, F.lit(WORD_DIGITS)), 16, 10).cast("bigint")
    words = F.transform(F.sequence(F.lit(0), count - 1), word)
    bits = lambda n, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.getbit(n, i) == 1), lambda i: w * WORD_BITS + i)
    return F.flatten(F.transform(words, bits))


def shred(documents: DataFrame) -> DataFrame:
    """Units of documents (project, episode_id, content): project, episode_id, category, idx, kind, item (JSON text, null where there is nothing)."""
    members = F.try_variant_get(F.try_parse_json("content"), "$", "map<string,variant>")
    checked = F.when(members.isNull(), F.raise_error(F.lit("content is no JSON object")).cast("map<string,variant>")).otherwise(members)
    lists = documents.select(*DOC, F.explode_outer(checked).alias("category", "_v")).withColumn("_l", F.try_variant_get("_v", "$", "array<variant>"))
    spread = lists.select(*DOC, "category", "_v", F.col("_l").isNull().alias("_single"), F.posexplode_outer("_l").alias("_at", "_item"))
    is_object = F.try_variant_get("_item", "$", "map<string,variant>").isNotNull()
    kind = F.when(F.col("category").isNull(), "none").when(F.col("_single"), "scalar").when(F.col("_at").isNull(), "empty").when(is_object, "row").otherwise("literal")
    return spread.select(
        *DOC, F.coalesce("category", F.lit("")).alias("category"), F.coalesce("_at", F.lit(0)).cast("bigint").alias("idx"), kind.alias("kind"),
        F.when(kind == "scalar", F.to_json("_v")).when(kind.isin("row", "literal"), F.coalesce(F.to_json("_item"), F.lit("null"))).alias("item"),
    )


def assemble(units: DataFrame) -> DataFrame:
    """Documents (project, episode_id, content) of units; content in VARIANT's own form. A document came as one value, so it meets in one place."""
    together = units.repartition(*DOC)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda u: u["item"])
    values = together.groupBy(*DOC, "category", F.when(F.col("kind").isin("row", "literal"), "list").otherwise(F.col("kind")).alias("kind")).agg(listed.alias("_l"))
    value = F.when(F.col("kind") == "list", _whole(F.col("_l"), ",", "[]")).when(F.col("kind") == "empty", "[]").when(F.col("kind") == "scalar", F.col("_l")[0])
    member = F.when(value.isNotNull(), F.concat(F.to_json(F.col("category").cast("variant")), F.lit(":"), value))
    content = _whole(F.array_sort(F.collect_list("_m")), ",", "{}")
    return values.withColumn("_m", member).groupBy(*DOC).agg(content.alias("_c")).select(*DOC, F.to_json(F.parse_json("_c")).alias("content"))


def _seconds(ms: Column) -> Column:
    """The JSON text of a JSON number of milliseconds in seconds."""
    return F.to_json(F.try_parse_json((ms.try_cast("double") / 1000).cast("string")))


def described(units: DataFrame) -> DataFrame:
    """(unit, kind, fields): fields of rows, and the whole of literals and scalars, as JSON texts: name, value, derived, told.

    `derived`: the value follows from the episode or from milliseconds, to the letter. `told`: the first field of the row with
    the same value that is not derived, where that is worth a reference. Units without fields have null.
    """
    members = F.map_entries(F.try_variant_get(F.try_parse_json("item"), "$", "map<string,variant>"))
    own = F.array_sort(F.transform(members, lambda e: F.struct(e["key"].alias("name"), F.to_json(e["value"]).alias("value"))))
    single = F.array(F.struct(F.lit("").alias("name"), F.col("item").alias("value")))
    rows = _once(units, "_f", F.when(F.col("kind") == "row", own).when(F.col("kind").isin("literal", "scalar"), single))
    at = lambda name: F.try_element_at(F.filter("_f", lambda f: f["name"] == name), F.lit(1))["value"]
    rows = _once(rows, "_k", F.struct(F.to_json(F.col("episode_id").cast("variant")).alias("episode"), _seconds(at("start_ms")).alias("start"), _seconds(at("end_ms")).alias("end")))
    follows = lambda f: F.when(F.col("kind") != "row", False).otherwise(F.coalesce(
        ((f["name"] == "episode_id") & (f["value"] == F.col("_k.episode")))
        | ((f["name"] == "start_sec") & (f["value"] == F.col("_k.start"))) | ((f["name"] == "end_sec") & (f["value"] == F.col("_k.end"))), F.lit(False)))
    marked = _once(rows, "_d", F.transform("_f", lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), follows(f).alias("derived"))))
    marked = _once(marked, "_given", F.transform("_d", lambda f: F.when(~f["derived"], f["value"])))
    first = lambda f: F.array_position("_given", f["value"])
    told = lambda f, i: F.when(~f["derived"] & (F.octet_length(f["value"]) > 4) & (first(f) < i + 1), F.get("_d", (first(f) - 1).cast("int"))["name"])
    full = F.transform("_d", lambda f, i: F.struct(f["name"].alias("name"), f["value"].alias("value"), f["derived"].alias("derived"), told(f, i).alias("told")))
    return marked.select(*UNIT, "kind", full.alias("fields"))


def fields_of(units: DataFrame) -> DataFrame:
    """(unit, kind, name, value, derived, told): a row a field of `described` units; those without fields keep one without a name."""
    return _apart(described(units))


def _apart(held: DataFrame) -> DataFrame:
    return held.select(*UNIT, "kind", F.explode_outer("fields").alias("_x")).select(*UNIT, "kind", "_x.*")


def _pieces(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(PIECE), F.lit(0))


def _is_string(piece: Column) -> Column:
    return F.startswith(piece, F.lit('"')) & ~F.endswith(piece, F.lit('":'))


def dictionary(fields: DataFrame) -> DataFrame:
    """(project, value, saving, code): strings of a project, at any depth, that repeat and are long enough to save bytes, the best first.

    Counts combine map-side; the numbering runs over what is kept, which repeats at least twice.
    """
    texts = fields.select("project", F.explode(F.filter(_pieces(F.col("value")), _is_string)).alias("value"))
    size = F.octet_length("value")
    saving = (size - 4) * F.col("n") - size
    kept = texts.groupBy("project", "value").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (size >= LEAST) & (saving > 0)).withColumn("saving", saving)
    numbered = ranked(kept, ["project"], [F.desc("saving"), F.asc("value")], "_n")
    return numbered.select("project", "value", "saving", (F.col("_n") - 1).alias("code"))


def columns_of(fields: DataFrame) -> DataFrame:
    """(project, category, name, col): field numbers from 0 per category, in name order. Field names are few."""
    names = fields.where("kind = 'row' AND name IS NOT NULL").select("project", "category", "name").distinct()
    return names.withColumn("col", F.row_number().over(Window.partitionBy("project", "category").orderBy("name")) - 1)


def _named(rows: DataFrame, columns: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `_by` to rows: their category's columns as a map; other kinds of units have none and stay where they are."""
    names = columns.groupBy("project", "category").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("_by"))
    kind_row = F.col("kind") == "row"
    others = rows.where(~kind_row).withColumn("_by", F.lit(None).cast(names.schema["_by"].dataType))
    return rows.where(kind_row).join(names, ["project", "category"], "left").unionByName(others)


def pack(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, strings, columns) of units as `shred` gives them.

    rows: the unit's key, kind, mask and derived (rows only), values (array of JSON texts); strings: project, code, value; columns: project, category, name, col.
    """
    # Counted, numbered and coded: read three times, so worked out once.
    held = durable(described(units))
    strings, columns = dictionary(_apart(held)), columns_of(_apart(held))
    apart = lambda f: ~f["derived"] & f["told"].isNull()
    coded = lambda f: F.filter(_pieces(f["value"]), lambda p: _is_string(p) & (F.octet_length(p) >= LEAST))
    lookup = strings.select("project", F.col("value").alias("_p"), "code")
    # Only strings that may be in the dictionary leave their unit, once each, and their codes come back as one map.
    asked = held.select(*UNIT, F.explode(F.array_distinct(F.flatten(F.transform(F.filter("fields", apart), coded)))).alias("_p")).join(lookup, ["project", "_p"])
    codes = asked.groupBy(*UNIT).agg(F.map_from_entries(F.collect_set(F.struct("_p", "code"))).alias("_codes"))
    entry = lambda f: F.struct(
        F.coalesce(F.try_element_at("_by", f["name"]), F.lit(0)).alias("col"), f["name"].alias("name"), f["derived"].alias("derived"), f["told"].alias("told"), f["value"].alias("value")
    )
    listed = F.coalesce(F.transform("fields", entry), F.array().cast("array<struct<col:int,name:string,derived:boolean,told:string,value:string>>"))
    rows = _once(_named(held, columns, "name", "col").join(codes, UNIT, "left"), "_l", F.array_sort(listed))
    rows = _once(rows, "_names", F.transform("_l", lambda f: f["name"]))

    def token(p: Column) -> Column:
        code = F.try_element_at("_codes", p)
        escaped = F.when(_is_string(p) & p.rlike(r'^"[~^]'), F.concat(F.lit('"'), F.substr(p, F.lit(2), F.lit(1)), F.substr(p, F.lit(2)))).otherwise(p)
        return F.when(code.isNotNull(), F.concat(F.lit('"~'), base36(code), F.lit('"'))).otherwise(escaped)

    text = lambda f: F.array_join(F.transform(_pieces(f["value"]), token), "")
    back = lambda f: F.concat(F.lit('"^'), base36(F.get("_l", (F.array_position("_names", f["told"]) - 1).cast("int"))["col"]), F.lit('"'))
    given = F.transform(F.filter("_l", lambda f: ~f["derived"]), lambda f: F.when(f["told"].isNotNull(), back(f)).otherwise(text(f)))
    mask = lambda kept: F.when(F.col("kind") == "row", hex_mask(F.transform(kept, lambda f: f["col"])))
    packed = rows.select(*UNIT, "kind", mask(F.col("_l")).alias("mask"), mask(F.filter("_l", lambda f: f["derived"])).alias("derived"), given.alias("values"))
    # Read twice to unpack it: for its references and for its rows.
    return durable(packed), strings.select("project", "code", "value"), columns


def unpack(rows: DataFrame, strings: DataFrame, columns: DataFrame) -> DataFrame:
    """The exact inverse of `pack`: units.

    A row whose values do not fit its masks, a reference to a column not given, to a string not in the dictionary or to a column not named fails the job.
    """
    single = F.when(F.col("kind").isin("literal", "scalar"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    bits = lambda mask: F.when(F.col("kind") == "row", mask_bits(F.col(mask))).otherwise(F.array().cast("array<int>"))
    # References go to the dictionary once a unit, and their strings come back as one map; so do a category's column names.
    refs = F.array_distinct(F.flatten(F.transform("values", lambda v: F.filter(_pieces(v), lambda p: p.rlike(REF)))))
    asked = rows.select(*UNIT, F.explode(refs).alias("_p")).withColumn("code", F.conv(F.regexp_extract("_p", REF, 1), 36, 10).cast("bigint"))
    told = asked.join(strings, ["project", "code"]).groupBy(*UNIT).agg(F.map_from_entries(F.collect_set(F.struct("_p", "value"))).alias("_told"))
    rows = _named(rows, columns, "col", "name").join(told, UNIT, "left")
    wide = _once(_once(rows, "_d", bits("derived")), "_c", F.when(F.col("kind") == "row", F.array_except(bits("mask"), "_d")).otherwise(single))
    fits = F.when(F.size("_c") != F.size("values"), F.raise_error(F.lit("row does not fit its mask")).cast("array<string>")).otherwise(F.col("values"))
    # A reference to a column not given has place 0, which no array has.
    place = lambda v: F.array_position("_c", F.conv(F.substr(v, F.lit(3), F.length(v) - 3), 36, 10).cast("int")).cast("int")
    seen = F.transform(fits, lambda v: F.when((F.col("kind") == "row") & v.rlike(r'^"\^[0-9a-z]+"$'), F.element_at("values", place(v))).otherwise(v))

    def plain(p: Column) -> Column:
        known = F.coalesce(F.try_element_at("_told", p), F.raise_error(F.lit("no such string in the dictionary")).cast("string"))
        literal = F.when(_is_string(p) & p.rlike(r'^"(~~|\^\^)'), F.concat(F.lit('"'), F.substr(p, F.lit(3)))).otherwise(p)
        return F.when(p.rlike(REF), known).otherwise(literal)

    whole = lambda v: F.array_join(F.transform(_pieces(v), plain), "")
    lost = F.raise_error(F.lit("no such column")).cast("string")
    name = lambda c: F.when(F.col("kind") == "row", F.coalesce(F.try_element_at("_by", c), lost))
    derived = F.transform("_d", lambda c: F.struct(name(c).alias("name"), F.lit(None).cast("string").alias("_t"), F.lit(True).alias("_derived")))
    given = F.transform(F.arrays_zip(F.col("_c"), seen.alias("_v")), lambda z: F.struct(name(z["_c"]).alias("name"), whole(z["_v"]).alias("_t"), F.lit(False).alias("_derived")))
    met = _once(_once(wide, "_l", F.concat(given, derived)), "_k", F.to_json(F.col("episode_id").cast("variant")))
    at = lambda name: F.element_at(F.filter("_l", lambda f: f["name"] == name), 1)["_t"]
    rebuilt = lambda f: F.when(f["name"] == "episode_id", F.col("_k")).when(f["name"] == "start_sec", _seconds(at("start_ms"))).when(f["name"] == "end_sec", _seconds(at("end_ms")))
    member = lambda f: F.concat(F.to_json(f["name"].cast("variant")), F.lit(":"), F.when(f["_derived"], rebuilt(f)).otherwise(f["_t"]))
    item = F.when(F.col("kind") == "row", F.to_json(F.parse_json(_whole(F.transform("_l", member), ",", "{}")))).when(F.col("kind").isin("literal", "scalar"), F.col("_l")[0]["_t"])
    return met.select(*UNIT, "kind", item.alias("item"))
