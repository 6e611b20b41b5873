"""Licence scan by sentence rules: sentences to identifiers, identifier sequences to licences. Column functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "all rights reserved": "reserved",
    "licensed under the apache license version 2.0": "apache2_ref",
    "licensed under the apache license version 2.0 the license": "apache2_ref",
    "you may not use this file except in compliance with the license": "apache2_use",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "the mit license": "mit_title",
    "mit license": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2plus_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_see",
    "licensed under cc by 4.0": "ccby4_ref",
    "licensed under cc by-sa 4.0": "ccbysa4_ref",
    "licensed under cc by-nc 4.0": "ccbync4_ref",
    "licensed under cc by-nc-sa 4.0": "ccbyncsa4_ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4_ref",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "ccbysa4_ref",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "ccbync4_ref",
    "this work is dedicated to the public domain under cc0 1.0": "cc0_ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
}
# Rules in the order they are tried: licence, class, identifier sequence; what a rule takes later ones don't see.
RULES = (
    ("MIT", "permissive", "(mit_title )?mit_grant mit_notice (mit_warranty )?"),
    ("Apache-2.0", "permissive", "apache2_ref apache2_use apache2_copy apache2_warranty apache2_see "),
    ("BSD-3-Clause", "permissive", "bsd_grant bsd_source bsd_binary bsd_endorse "),
    ("BSD-2-Clause", "permissive", "bsd_grant bsd_source bsd_binary "),
    ("GPL-3.0-or-later", "copyleft", "gpl3plus_grant (gpl_warranty )?(gpl_see )?"),
    ("GPL-2.0-or-later", "copyleft", "gpl2plus_grant (gpl_warranty )?(gpl_see )?"),
    ("Apache-2.0", "permissive", "apache2_ref "),
    ("MIT", "permissive", "mit_ref "),
    ("GPL-3.0-only", "copyleft", "gpl3_ref "),
    ("GPL-2.0-only", "copyleft", "gpl2_ref "),
    ("CC-BY-NC-SA-4.0", "noncommercial", "ccbyncsa4_ref "),
    ("CC-BY-NC-4.0", "noncommercial", "ccbync4_ref "),
    ("CC-BY-SA-4.0", "copyleft", "ccbysa4_ref "),
    ("CC-BY-4.0", "permissive", "ccby4_ref "),
    ("CC0-1.0", "permissive", "cc0_ref "),
    ("All-rights-reserved", "reserved", "(copyright )?reserved "),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"^copyright (c )?[0-9]{4}\b.*"
# Words of a sentence may stand on two lines or on either side of ; and :, where sentences may also start and end.
BETWEEN = r"[ ;:\n]+"
# What stands before "is licensed under" or "is free software": up to eight words that don't deny it.
SUBJECT = r"(?!(?:no|not|none|nothing|neither|nor)\b)(?:[a-z0-9.+\-]+" + BETWEEN + "){1,8}?"


def _known() -> str:
    """Known sentences as one pattern of text as folded() gives it, the longest first."""
    words = lambda sentence: BETWEEN.join(re.escape(w) for w in sentence.split(" "))
    either = lambda found: "(?:" + "|".join(words(x) for x in sorted(found, key=lambda x: (-len(x), x))) + ")"
    rest = {x.removeprefix("this program ") for x in SENTENCES if x.startswith("this program ")}
    references = {re.sub("^this work is ", "", x) for x in SENTENCES if re.match("(this work is )?(licensed|released) under ", x)}
    others = {x for x in SENTENCES if not x.startswith("this program ")}
    reference = either(references).replace(f"under{BETWEEN}", f"under{BETWEEN}(?:{words('the terms of')}{BETWEEN})?")
    return "|".join((
        either(others).replace(words("name of the copyright holder nor"), words("name of") + BETWEEN + r"[\s\S]{1,120}?[ ;:\n|]" + "nor").replace("http" + BETWEEN, "https?" + BETWEEN),
        rf"{SUBJECT}{either(rest)}",
        rf"(?:{SUBJECT}(?:is|are){BETWEEN})?{reference}(?:[ ;:\-]+see{BETWEEN}[^|]{{1,120}}?)?",
        rf"copyright{BETWEEN}(?:c{BETWEEN})?[0-9]{{4}}\b[^|\n]*",
    ))


KNOWN = rf"(?:^|[|\n;:])[ .\-]*({_known()})(?=[ .\-]*(?:[|\n;:]|$))"


def folded(text: Column) -> Column:
    """A text in which | is an end of a sentence and a line break need not be one.

    . ! or ? before white space and blank lines are ends, but not a blank line before an address. What is
    no letter or digit, and rem or dnl, is taken from the start of lines, so comment marks go.
    """
    out = F.translate(text, UPPER + "|", LOWER + " ")
    for pattern, by in (
        (r"(^|\n)[^a-z0-9\n]*(?:(?:rem|dnl)(?![a-z0-9])[^a-z0-9\n]*)?", "$1"),
        (r"[.!?](?=[ \t\r\f\x0B\n]|$)", "|"),
        (r"(?<!\n)\n++(?=https?:)", "\n"),
        (r"\n\n+", "|"),
        (r"[^a-z0-9.+\-|\n;:]+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out


def sentences(text: Column) -> Column:
    """The known sentences of a text, normalised, in text order; those of a line as well as those wrapped over lines."""
    return F.transform(F.regexp_extract_all(folded(text), F.lit(KNOWN), F.lit(1)), normalised)


def normalised(sentence: Column) -> Column:
    """A-Z in lower case; other than letters, digits and .+- one space; none of .- and spaces at the ends."""
    plain = F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[^a-z0-9.+\-]+", " ")
    return F.regexp_replace(plain, r"^[ .\-]+|[ .\-]+$", "")


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null for one that is none of the known; subjects and names of holders are free."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    plain = sentence
    for pattern, by in (
        (r"^.*? (?=is free software you |is distributed in the hope )", "this program "),
        (r"^.*? (?:is|are) (?=(?:licensed|released) under )", ""),
        (r"^((?:licensed|released) under )the terms of ", "$1"),
        (r"^((?:licensed|released) under .*?) (?:- )*see .*$", "$1"),
        (r"^neither the name of .* nor the names of ", "neither the name of the copyright holder nor the names of "),
        (r" https (?=www)", " http "),
    ):
        plain = F.regexp_replace(plain, pattern, by)
    return F.when(sentence.rlike(COPYRIGHT), F.lit("copyright")).otherwise(F.coalesce(F.element_at(known, sentence), F.element_at(known, plain)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, classes, unmatched) per document row.

    sentence_ids are the identifiers of the known sentences in text order, on one line or wrapped. Rules are tried in order on this
    sequence; each takes all its matches out, so a whole grant is not also read as its parts. licenses and
    classes are sorted sets; unmatched counts the known sentences no rule took. A null or empty text
    has none of either. Rows that repeat a doc_id, or have none, are scanned one by one. Every row keeps
    to its own task: there is no shuffle. Only doc_id and text are read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = F.filter(F.transform(sentences(text), identifier), lambda x: x.isNotNull())
    found = docs.select("doc_id", ids.alias("ids"))
    return match_rules(found)


def match_rules(found: DataFrame) -> DataFrame:
    """Licences of (doc_id, ids) rows; a row's sequence is a string in which each identifier ends with a space."""
    rest, hits = F.concat_ws("", F.transform("ids", lambda x: F.concat(x, F.lit(" ")))), []
    df = found.withColumn("rest0", rest)
    for i, (name, kind, pattern) in enumerate(RULES):
        # The space before an identifier is looked at, not taken, so matches may follow one another.
        whole = rf"(?<![a-z0-9_]){pattern}"
        last = F.col(f"rest{i}")
        hits.append(F.when(F.col(f"hit{i}"), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))))
        df = df.withColumns({f"hit{i}": last.rlike(whole), f"rest{i + 1}": F.regexp_replace(last, whole, "; ")})
    taken = F.filter(F.array(*hits), lambda h: h.isNotNull())
    left = F.filter(F.split(f"rest{len(RULES)}", " "), lambda x: ~x.isin("", ";"))
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.concat_ws(" ", "ids").alias("sentence_ids"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(taken, lambda h: h["name"])))).alias("licenses"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(taken, lambda h: h["kind"])))).alias("classes"),
        F.size(left).cast("long").alias("unmatched"),
    )
