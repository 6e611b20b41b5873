"""Web captures: not-modified revisits resolved to the latest earlier full response of their canonical address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.session import durable

# Header fields of a 304 response that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Time ranges into which captures are cut, each about as full as another.
RANGES = 64


def canonical_url(url: Column) -> Column:
    """One address for all spellings of a page: no scheme, user, www., default port, fragment or final slash; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(bare, "^[^/?]*", ""), "/+$", "")
    return F.concat(host, path)


def parsed_headers(block: Column) -> Column:
    """A block of header lines as a map by lower-case name; of equal names the last line counts, lines without a colon none."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    start = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, start, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["name"]), F.map_from_arrays(F.array(p["name"]), F.array(p["value"]))))


def weak_etag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Headers of the stored response with the permitted ones of the revisit in their place."""
    taken = F.map_filter(fresh, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(taken), k)), taken)


def time_ranges(captures: DataFrame, ranges: int = RANGES) -> Column:
    """Number of the time range of a capture: cuts are quantiles, so an address with very many captures is spread over ranges."""
    seconds = captures.select(F.unix_micros("at").cast("double").alias("s")).where("s IS NOT NULL")
    cuts = sorted(set(seconds.approxQuantile("s", [i / ranges for i in range(1, ranges)], 0.005) or []))
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c <= F.unix_micros("at").cast("double")))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """(record_id, canonical, at, source_id, source_at, outcome, digest, headers) of every revisit.

    captures: record_id, url, at, kind ('response' or 'revisit'), etag, last_modified, digest, headers (a map
    by lower-case name). The source is the latest response of the same canonical address that is strictly
    earlier; of several at one time the one with the greatest record_id. outcome:
      resolved      the validator of the revisit, its etag or else its last_modified, is the source's
      unvalidated   the revisit names no validator; it takes the source all the same
      mismatch      the validator differs or the source has none: no digest and the revisit's own headers
      no_source     no earlier response, no address or no time

    An address may hold any share of the rows: each is cut at quantiles of time. Inside a range a window
    finds the last response; over ranges only their last responses are looked through. Repeated rows are
    answered one by one. Other columns are not read; an empty table gives no rows.
    """
    kept = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "at", F.lower("kind").alias("kind"), "etag", "last_modified", "digest",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    ).withColumn("range", time_ranges(captures))
    found = durable(kept)
    placed = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    source = F.struct("at", "record_id", "etag", "last_modified", "digest", "headers").alias("source")
    responses = found.where("kind = 'response'").where(placed).select("canonical", "range", "at", F.col("record_id").alias("key"), source)
    one = responses.groupBy("canonical", "range", "at").agg(F.max_by("source", F.struct(F.col("key").isNotNull(), "key")).alias("source"))
    last = one.groupBy("canonical", "range").agg(F.max_by("source", "at").alias("source"))
    revisits = found.where("kind = 'revisit'")
    asked = revisits.where(placed)
    # Ranges an address has at all, each with the last response before it: one row per range, not per capture.
    heads = asked.select("canonical", "range").distinct().join(last, ["canonical", "range"], "full")
    before = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("earlier", F.last("source", ignorenulls=True).over(before)).select("canonical", "range", "earlier")
    # Inside a range: revisits and responses in time order; at one time revisits come first, they need an earlier one.
    rows = asked.select("canonical", "range", "at", F.struct("record_id", "etag", "last_modified", "headers").alias("revisit")).unionByName(
        one.select("canonical", "range", "at", "source"), allowMissingColumns=True
    )
    inside = Window.partitionBy("canonical", "range").orderBy("at", F.col("source").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("here", F.last("source", ignorenulls=True).over(inside)).where("revisit IS NOT NULL")
    joined = met.join(carried, ["canonical", "range"]).select("canonical", "at", "revisit", F.coalesce("here", "earlier").alias("source"))
    lost = revisits.where(~F.coalesce(placed, F.lit(False))).select("canonical", "at", F.struct("record_id", "etag", "last_modified", "headers").alias("revisit"), F.lit(None).cast(joined.schema["source"].dataType).alias("source"))
    r, s = F.col("revisit"), F.col("source")
    same = F.when(r["etag"].isNotNull(), weak_etag(r["etag"]) == weak_etag(s["etag"])).otherwise(r["last_modified"] == s["last_modified"])
    outcome = (
        F.when(s.isNull(), "no_source")
        .when(r["etag"].isNull() & r["last_modified"].isNull(), "unvalidated")
        .when(F.coalesce(same, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    taken = outcome.isin("resolved", "unvalidated")
    return joined.unionByName(lost).select(
        r["record_id"].alias("record_id"), "canonical", "at", s["record_id"].alias("source_id"), s["at"].alias("source_at"), outcome.alias("outcome"),
        F.when(taken, s["digest"]).alias("digest"),
        F.when(taken, merged_headers(s["headers"], r["headers"])).otherwise(r["headers"]).alias("headers"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures as a crawl of `pages` would make them: each page in full, then revisits whose validators come from its content.

    A page is fetched at a time given by its id and revisited one to three times. Every fifth page is revisited
    once more by an etag that is no longer its own, every seventh by its date alone, every eleventh
    by no validator, and every thirteenth was revisited before its first fetch.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 37)
    tag, date = F.md5(F.coalesce("html", F.lit(""))), F.date_format(at, "yyyy-MM-dd HH:mm:ss")

    def capture(kind: str, n: int, delay: int, etag: Column, modified: Column, extra: str) -> Column:
        block = F.concat(F.lit("Content-Type: text/html\r\nDate: "), F.date_format(at + F.make_interval(secs=F.lit(delay)), "yyyy-MM-dd HH:mm:ss"), F.lit(f"\r\n{extra}"))
        return F.struct(
            (F.col("page_id") * 8 + n).alias("record_id"), F.col("url"), (at + F.make_interval(secs=F.lit(delay))).alias("at"), F.lit(kind).alias("kind"), etag.alias("etag"),
            modified.alias("last_modified"), F.when(F.lit(kind == "response"), tag).alias("digest"), parsed_headers(block).alias("headers"),
        )

    none = F.lit(None).cast("string")
    made = [
        capture("response", 0, 0, tag, date, "Cache-Control: max-age=60\r\nServer: one"),
        capture("revisit", 1, 3600, F.concat(F.lit("W/"), tag), none, "Cache-Control: max-age=600\r\nServer: two"),
        F.when(F.col("page_id") % 5 == 0, capture("revisit", 2, 7200, F.md5(tag), none, "Vary: accept")),
        F.when(F.col("page_id") % 7 == 0, capture("revisit", 3, 86400, none, date, "Expires: never")),
        F.when(F.col("page_id") % 11 == 0, capture("revisit", 4, 90000, none, none, "Vary: *")),
        F.when(F.col("page_id") % 13 == 0, capture("revisit", 5, -60, tag, none, "Vary: *")),
    ]
    return pages.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("c")).select("c.*")
