"""Labels of case documents: agreements, types, joiners and authoring parties, and the metadata of their cases.

All are built-in column expressions; a null input gives what the docstring says for an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions import text as t

#: Agreements by the prefix of a document code; dispute settlement itself is no agreement.
AGREEMENTS = {
    "G/SPS/": "Sanitary and Phytosanitary Measures (SPS)",
    "G/TBT/": "Technical Barriers to Trade (TBT)",
    "G/SCM/": "Subsidies and Countervailing Measures (SCM)",
    "G/ADP/": "Anti-Dumping Practices (ADP)",
    "G/AG/": "Agriculture (AG)",
    "G/SG/": "Safeguards (SG)",
    "G/TRIMS/": "Trade-Related Investment Measures (TRIMS)",
    "G/RO/": "Rules of Origin (RO)",
    "G/VAL/": "Customs Valuation (VAL)",
    "G/LIC/": "Import Licensing (LIC)",
    "G/IT/": "Information Technology Agreement (ITA)",
    "G/L/": "General Council",
    "S/L/": "General Agreement on Trade in Services (GATS)",
    "IP/D/": "Trade-Related Aspects of Intellectual Property Rights (TRIPS)",
}
#: What goes from the head of a text, in any case and over lines.
HEADER = (
    r"WORLD\s+TRADE\s*\n?\s*ORGANIZATION",
    r"ORGANISATION\s+MONDIALE\s+DU\s+COMMERCE",
    r"ORGANIZACIÓN\s+MUNDIAL\s+DEL\s+COMERCIO",
    r"WT/DS\d+/[A-Za-z0-9/.\-]+",
    r"G/[A-Z]+/[A-Za-z0-9/.\-]+",
    r"S/L/\d+(?:/[A-Za-z0-9.]+)*",
    r"IP/D/\d+(?:/[A-Za-z0-9.]+)*",
    r"\(\d{2}-\d{4,5}\)\s*(?:Page:\s*\d+/\d+)?",
    r"Page:\s*\d+/\d+",
    r"^\s*\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\s*$",
    r"Original:\s*(?:English|French|Spanish)(?:/\w+)*",
    r"logo:\s*World Trade Organization.*?(?:(\n\n)|\z)",
    r"Visible Text and Design\s*:.*?(?:(\n\n)|\z)",
    r"Dimensions and Placement\s*:.*?(?:(\n\n)|\z)",
    r"Analysis\s*:.*?(?:(\n\n)|\z)",
    r"<!--.*?-->",
)
#: Document types by the class of the file name, then by its variant.
CLASS_TYPES = {
    "PANEL_REPORT": "Report_Of_Panel",
    "PANEL_REPORT_ADD": "Report_Of_Panel",
    "PANEL_REPORT_CORR": "Report_Of_Panel",
    "PANEL_REPORT_SUP": "Report_Of_Panel",
    "AB_REPORT": "Report_Of_Appellate_Body",
    "AB_REPORT_ADD": "Report_Of_Appellate_Body",
    "AB_REPORT_CORR": "Report_Of_Appellate_Body",
    "RECOURSE": "Art_21_5_Recourse",
    "RECOURSE_ADD": "Art_21_5_Recourse",
    "AB_RECOURSE": "Art_21_5_Recourse",
    "AB_RECOURSE_ADD": "Art_21_5_Recourse",
    "ARBITRATION": "Arbitration",
    "ARBITRATION_ADD": "Arbitration",
    "D_FILE": "Request_For_Consultations",
    "W_FILE": "Working_Document",
}
VARIANT_TYPES = {"Add": "Addendum", "Corr": "Corrigendum", "Rev": "Revision"}
#: How the first page names who joins, in the order of trial.
JOINERS = (
    r"(?i)communication\s+from\s+(\w[\w\s]+?)(?:\s*the\s+following|\s*$)",
    r"(?i)join(?:ing)?\s+(?:the\s+)?consultations?\s*(?:by|from)\s+(\w[\w\s]+?)(?:\s*the\s+following|\s*$)",
    r"(?i)communication\s+from\s+([A-Z][\w\s]+)",
)
#: Words that name an institution, in the order of trial, with its kind and its name.
INSTITUTIONS = (
    (("panel",), "panel", "Panel"),
    (("appellate body", "appellate division"), "appellate_body", "Appellate Body"),
    (("arbitrator",), "arbitrator", "Arbitrator"),
    (
        ("secretariat", "director-general", "director general", "chairman of the dsb", "chairperson of the dsb", "chairman of the dispute settlement body", "chairperson of the dispute settlement body"),
        "secretariat",
        "Secretariat",
    ),
)


#: Lines of a first page that are no part of a title.
NO_TITLE = r"(?i)^(WORLD\s+TRADE|ORGANIZATION|ORGANISATION|ORGANIZACIÓN|Original:|Page:)|^((?-i)WT/|G/|S/L/|IP/|\d{1,2}\s+\w+\s+\d{4}|\(\d{2}-\d{4,5}\))"


def agreements(codes: Column) -> Column:
    """Distinct agreements of an array of codes in alphabetical order; codes of none are passed over, a null array has none."""
    begins = lambda prefix: F.exists(codes, lambda c: F.startswith(c, F.lit(prefix)))
    named = [F.when(begins(prefix), F.lit(name)) for prefix, name in AGREEMENTS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))


def without_header(text: Column, head: int = 2000) -> Column:
    """The text without what pages repeat in its head; what follows the head stays. An empty line after a block is kept."""
    start = F.substring(text, 1, head)
    for pattern in HEADER:
        start = F.regexp_replace(start, "(?ismdU)" + pattern, "$1" if r"(\n\n)" in pattern else "")
    return F.concat(start, F.substring(text, F.lit(head + 1), F.length(text)))


def fallback_type(file_class: Column, variant: Column) -> Column:
    """A document's type where its text names none: by the class of its file name, else by the variant, else UNKNOWN."""
    return F.coalesce(t.mapped(file_class, CLASS_TYPES), t.mapped(variant, VARIANT_TYPES), F.lit("UNKNOWN"))


def joiner(doc_type: Column, text: Column, first: int = 1500) -> Column:
    """Who joins a dispute as its first page says, UNKNOWN if it does not; null for documents of other types."""
    page = F.regexp_replace(F.substring(text, 1, first), r"\s+", " ")
    found = [F.trim(F.regexp_extract(page, p, 1)) for p in JOINERS]
    found[2] = F.trim(F.regexp_replace(found[2], r"(?i)\s+the\s+following.*$", ""))
    return F.when(F.contains(F.lower(doc_type), F.lit("join")), F.coalesce(*(F.nullif(x, F.lit("")) for x in found), F.lit("UNKNOWN")))


def case_title(text: Column, first: int = 1500) -> Column:
    """The title on a first page, empty if it has none: from the first line of capitals with a dash and over ten letters
    on, all lines of capitals with over five, up to an empty or another line; heading lines in between do not end it."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    state = lambda title, place: F.struct(title.alias("title"), F.lit(place).alias("place"))

    def step(seen: Column, x: Column) -> Column:
        """place is 0 before the title, 1 in it and 2 after it."""
        inside, title = seen["place"] == 1, seen["title"]
        capital = ((F.upper(x) == x) & (F.lower(x) != x)) | (F.length(F.regexp_replace(x, r"\P{Lu}", "")) > F.length(x) * 0.6)
        opens = inside | ((F.length(x) > 10) & x.rlike(r"[–\-—]"))
        return (
            F.when((seen["place"] == 2) | ((x != "") & x.rlike(NO_TITLE)), seen)
            .when((F.length(x) > 5) & opens & capital, state(F.concat(title, F.array(x)), 1))
            .when(inside, state(title, 2))
            .otherwise(seen)
        )

    lines = F.transform(F.split(F.substring(text, 1, first), "\n"), strip)
    found = F.aggregate(lines, state(F.array().cast("array<string>"), 0), step)
    return F.coalesce(F.array_join(found["title"], " "), F.lit(""))


_RULE, _NUMBERED = re.compile(r"_{3,}$"), re.compile(r"\d{1,3}[\s.)]")


def _footnotes_cut(text: str | None) -> str | None:
    if text is None or "___" not in text:
        return text
    kept: list[str] = []
    blank: list[str] = []
    block = numbered = False
    for line in text.split("\n"):
        bare = line.strip()
        if block and not bare:
            blank.append(line)
            continue
        if block and _NUMBERED.match(bare):
            blank, numbered = [], True
            continue
        if block and numbered and not blank and not bare[0].isupper():
            continue
        kept += blank
        blank, numbered, block = [], False, _RULE.match(bare) is not None
        if not block:
            kept.append(line)
    return "\n".join(kept + blank)


def without_footnotes(text: Column) -> Column:
    """The text without rules of underscores and the numbered notes below them; a note goes on over lines that do not
    begin with a capital, and empty lines between notes go too. One pass over the lines, as a note depends on those before.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(_footnotes_cut)

    return cut(text)


def semantic_names(files: DataFrame) -> DataFrame:
    """files with a column new_name from case_number, seq, doc_type, variant, variant_number and part_number.

    A variant above the first has its number, parts have two digits, and plain files of a type that a case has several
    of are numbered from 0 by seq. An empty variant is none; equal seq are numbered in any order.
    """
    no_variant = F.coalesce(F.col("variant"), F.lit("")) == ""
    plain = no_variant & F.col("part_number").isNull()
    group = Window.partitionBy("case_number", "doc_type", plain)
    twice = plain & (F.count(F.lit(1)).over(group) > 1)
    variant = F.concat(F.lit("_"), F.col("variant"), F.when(F.col("variant_number") > 1, F.col("variant_number").cast("string")).otherwise(""))
    return files.withColumn(
        "new_name",
        F.concat(
            F.format_string("DS%s_SEQ%02d_%s", F.col("case_number").cast("string"), "seq", "doc_type"),
            F.when(no_variant, "").otherwise(variant),
            F.when(F.col("part_number").isNull(), "").otherwise(F.format_string("_%02d", "part_number")),
            F.when(twice, F.format_string("_%02d", F.row_number().over(group.orderBy("seq")) - 1)).otherwise(""),
            F.lit(".pdf"),
        ),
    )


def same_party(entity: Column, party: Column, aliases: Mapping[str, str]) -> Column:
    """Whether two names are one by normal form or alias, or one of at least three letters is part of the other."""
    a, b = (t.normal_name(x) for x in (entity, party))
    x, y = t.alias(a, aliases), t.alias(b, aliases)
    part = (F.length(x) >= 3) & (F.length(y) >= 3) & (F.contains(x, y) | F.contains(y, x))
    return (a != "") & (b != "") & ((a == b) | (x == y) | part)


def authoring_party(entity: Column, complainants: Column, respondents: Column, third_parties: Column, aliases: Mapping[str, str]) -> Column:
    """kind and name of an author: an institution, else the first party that matches, by role in this order, else a
    third party of its own name if that has more than two letters, else unknown."""
    lower = t.normal_name(entity)
    answer = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"))
    chosen = [F.when(F.lit(False), answer(F.lit(""), F.lit("")))]
    for words, kind, name in INSTITUTIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lower, F.lit(w))
        chosen.append(F.when(hit, answer(F.lit(kind), F.lit(name))))
    for kind, parties in (("complainant", complainants), ("respondent", respondents), ("third_party", third_parties)):
        first = F.try_element_at(F.filter(parties, lambda p: same_party(entity, p, aliases)), F.lit(1))
        chosen.append(F.when(first.isNotNull(), answer(F.lit(kind), first)))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(entity), r"(?i)^the\s+", ""), r"[.,;:]+$", ""))
    chosen.append(F.when(F.length(bare) > 2, answer(F.lit("third_party"), bare)))
    return F.coalesce(*chosen, answer(F.lit("unknown"), entity))


def with_case_metadata(documents: DataFrame, number: str, metadata: DataFrame, case: str, fields: list[str]) -> DataFrame:
    """documents with the fields of their case, whose number follows DS in the case's name; empty where there is none.

    Of several rows of one number that with the largest name, then the largest fields, counts.
    """
    key = F.nullif(F.regexp_extract(case, r"DS(\d+)", 1), F.lit(""))
    named = metadata.select(key.alias("_number"), F.struct(case, *fields).alias("_row")).filter("_number is not null")
    one = named.groupBy("_number").agg(F.max("_row").alias("_row"))
    joined = documents.join(one, F.col(number).cast("string") == F.col("_number"), "left")
    return joined.select(*(documents[c] for c in documents.columns), *(F.coalesce(F.col("_row")[f], F.lit("")).alias(f) for f in fields))
