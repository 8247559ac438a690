"""Labels by cascades of rules: each document or case by the first stage that knows, with the stage and its confidence.

What every stage would need is extracted once; the stages choose among these columns, and the one name that was chosen
is matched with the parties once. What only an external model can tell is marked so and not asked here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.labels import authoring_party

#: Who writes documents of a type, and the name where it is the same for all; None where the text tells.
AUTHORS = {
    "Request_For_Consultations": ("complainant", None),
    "Request_For_Establishment_Of_Panel": ("complainant", None),
    "Request_Regarding_Consultations": ("complainant", None),
    "Request_To_Reactivate_Consultations": ("complainant", None),
    "Request_To_Join_Consultations": ("third_party", None),
    "Report_Of_Panel": ("panel", "Panel"),
    "Working_Procedures": ("panel", "Panel"),
    "Questions_And_Replies": ("panel", "Panel"),
    "Interim_Review": ("panel", "Panel"),
    "Terms_Of_Reference": ("panel", "Panel"),
    "Report_Of_Appellate_Body": ("appellate_body", "Appellate Body"),
    "Appellate_Body_Report_And_Panel_Report": ("appellate_body", "Appellate Body"),
    "Arbitration_Award": ("arbitrator", "Arbitrator"),
    "Appointment_Of_Arbitrator": ("secretariat", "Secretariat"),
    "Note_By_Secretariat": ("secretariat", "Secretariat"),
    "Cancelled_Document": ("secretariat", "Secretariat"),
    "DSB_Action": ("secretariat", "Secretariat"),
    "Panel_Composition": ("secretariat", "Secretariat"),
    "Extension_Of_Time_Period": ("secretariat", "Secretariat"),
    "Notification_Of_Mutually_Agreed_Solution": ("joint", None),
    "Understanding": ("joint", None),
    "Agreed_Procedures": ("joint", None),
    "Agreement_Art_21_3": ("joint", None),
    "Notification_Of_Agreement": ("joint", None),
    "Corrigendum": ("secretariat", "Secretariat"),
    "Modification": ("secretariat", "Secretariat"),
    "Report_By_Director_General": ("secretariat", "Secretariat"),
    "Transcript": ("panel", "Panel"),
}
#: Types whose author may stand after "submissions of".
SUBMITTED = ("Addendum", "Executive_Summary", "Submission")
#: How a head names its author, the mission first.
MISSION = r"(?i)from\s+the\s+Permanent\s+Mission\s+of\s+(.+?)\s+to\s+the"
BY_FROM = (
    r"(?is)\b(?:Communication\s+)?(?:by|from)\s+((?:the\s+)?(?:Permanent\s+Mission\s+of\s+)?.+?)"
    r"(?=\s*(?:Addendum|Corrigendum|Revision|Supplement|Annex|under\s+(?:Article|paragraph|the\s+Understanding|the\s+DSU)|pursuant|The\s+following|This\s+communication|Thefollowing|$|\n|\r))"
)
SUBMISSIONS = r"(?i)submissions?\s+of\s+((?:the\s+)?.+?)(?:\s+Contents|\s+Page|\n|$)"
#: Fixed value: characters of a text that may name its author.
HEAD = 500
SECTIONS = 21


def _bare(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[.,;:]+$", ""), r"^\s+|\s+$", "")


def named_author(text: Column) -> Column:
    """The name after "by" or "from" in the head of a text, or of the mission that it is from; null if there is none of
    more than two letters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    mission = _bare(F.regexp_extract(head, MISSION, 1))
    other = _bare(F.regexp_replace(F.regexp_replace(F.regexp_extract(head, BY_FROM, 1), r"^\s+|\s+$", ""), r"(?i)^the\s+Permanent\s+Mission\s+of\s+", ""))
    return F.when(F.length(mission) > 2, mission).when(F.length(other) > 2, other)


def submitting_party(raw: Column, text: Column) -> Column:
    met = lambda x: F.nullif(_bare(F.regexp_extract(x, SUBMISSIONS, 1)), F.lit(""))
    return F.coalesce(met(F.coalesce(raw, F.lit(""))), met(F.substring(F.coalesce(text, F.lit("")), 1, HEAD)))


def with_author(df: DataFrame, doc_type: str, raw: str, text: str, complainants: str, respondents: str, third_parties: str, aliases: Mapping[str, str]) -> DataFrame:
    """df with author, author_name, author_confidence and author_stage (rule, raw_extract, text_extract or external).

    By the document's type, else by the name in the raw type, else by that in the head of the text, else, for
    submissions, by the party that they are of. A name is matched with the parties, arrays of the case. Rows that no
    stage knows are unknown, for an external model to label. Null texts and unknown types go on to the next stage.
    """
    kinds = F.create_map(*(F.lit(x) for t, (kind, _) in AUTHORS.items() for x in (t, kind)))
    names = F.create_map(*(x for t, (_, name) in AUTHORS.items() for x in (F.lit(t), F.lit(name).cast("string"))))
    joined = lambda c: F.array_join(F.col(c), ", ")
    some = lambda c, other: F.when(F.size(c) > 0, joined(c)).otherwise(other)
    rows = df.withColumns({"_kind": kinds[F.col(doc_type)], "_name": names[F.col(doc_type)], "_raw": named_author(F.col(raw)), "_text": named_author(F.col(text)), "_of": submitting_party(F.col(raw), F.col(text))})
    submitted = F.col(doc_type).isin(*SUBMITTED) & F.col("_of").isNotNull()
    stage = F.when(F.col("_kind").isNotNull(), "rule").when(F.col("_raw").isNotNull(), "raw_extract").when(F.col("_text").isNotNull() | submitted, "text_extract").otherwise("external")
    third = F.col("_kind") == "third_party"
    entity = F.when(F.col("_kind").isNotNull() & ~third, None).otherwise(F.coalesce("_raw", "_text", F.when(submitted, F.col("_of"))))
    rows = rows.withColumns({"author_stage": stage, "_entity": entity, "_third_parties": F.col("_raw").isNull() & F.col("_text").isNull() & F.contains(F.lower("_of"), F.lit("third part"))})
    rows = rows.withColumn("_match", F.when(F.col("_entity").isNotNull(), authoring_party(F.col("_entity"), F.col(complainants), F.col(respondents), F.col(third_parties), aliases)))
    by_rule = (
        F.when(F.col("_name").isNotNull(), F.col("_name"))
        .when(F.col("_kind") == "complainant", some(complainants, "Complainant"))
        .when(F.col("_kind") == "joint", F.concat(joined(complainants), F.lit(" & "), joined(respondents)))
        .otherwise(F.when(F.col("_raw").isNull() & F.col("_text").isNull(), "Third Party").otherwise(F.col("_match.name")))
    )
    ruled, extracted = F.col("author_stage") == "rule", F.col("author_stage").isin("raw_extract", "text_extract")
    group = extracted & F.coalesce("_third_parties", F.lit(False))
    author = F.when(ruled, F.col("_kind")).when(group, "third_party").when(extracted, F.col("_match.kind")).otherwise("unknown")
    name = F.when(ruled, by_rule).when(group, "Third Parties").when(extracted, F.col("_match.name")).otherwise("Unknown")
    sure = F.when(ruled, "high").when(F.col("author_stage") == "raw_extract", F.when(F.col("_match.kind") == "unknown", "medium").otherwise("high")).when(extracted, "medium").otherwise("low")
    out = rows.withColumns({"author": author, "author_name": name, "author_confidence": sure})
    return out.drop("_kind", "_name", "_raw", "_text", "_of", "_entity", "_third_parties", "_match")


def chapter_section(code: Column) -> Column:
    """Section 1 to 21 of a commodity code by its chapter, null if it has none."""
    chapter = F.regexp_extract(F.regexp_replace(code, r"[^0-9]", ""), r"^(\d{2})", 1).try_cast("int")
    #: The last chapter of each section.
    ends = (5, 14, 15, 24, 27, 38, 40, 43, 46, 49, 63, 67, 70, 71, 83, 85, 89, 92, 93, 96, 97)
    return F.when(chapter.between(1, ends[-1]), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < chapter)) + 1)


def with_sections(df: DataFrame, codes: str, found: str, found_kind: str, title: str, title_kind: str) -> DataFrame:
    """df with sections (numbers in order, joined by |), case_type, method and confidence.

    Codes are listed with | between them, NAN being none. They tell the sections of their chapters; else the sections
    that a model has found, numbers out of range left out and all sections standing for none; where it was not asked or
    failed (null), those by the title, and without those all sections, a matter of policy.
    """
    listed = F.filter(F.transform(F.split(F.coalesce(F.col(codes), F.lit("")), r"\|"), lambda c: F.trim(c)), lambda c: (c != "") & (F.upper(c) != "NAN"))
    explicit = F.array_sort(F.array_distinct(F.array_compact(F.transform(listed, chapter_section))))
    every = F.sequence(F.lit(1), F.lit(SECTIONS))
    valid = lambda c: F.array_sort(F.array_distinct(F.filter(F.col(c), lambda s: s.between(1, SECTIONS))))
    rows = df.withColumns({"_explicit": explicit, "_found": valid(found), "_title": valid(title)})
    by_code, by_model = F.size("_explicit") > 0, F.col(found).isNotNull()
    full = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(every)
    model, named = full("_found"), F.col(title).isNotNull() & (F.size("_title") > 0)
    numbers = F.when(by_code, F.col("_explicit")).when(by_model, model).when(named, F.col("_title")).otherwise(every)
    kind = F.when(by_code, "product").when(by_model, F.col(found_kind)).when(named, F.col(title_kind)).otherwise("policy")
    method = F.when(by_code, "explicit_hs").when(by_model, "model").otherwise("title_fallback")
    sure = F.when(by_code, "high").when(by_model, F.when((F.col(found_kind) == "product") & (F.size(model) < SECTIONS), "high").otherwise("medium")).otherwise("low")
    text = F.array_join(F.transform(numbers, lambda s: s.cast("string")), "|")
    return rows.withColumns({"sections": text, "case_type": kind, "method": method, "confidence": sure}).drop("_explicit", "_found", "_title")


def one_row_a_section(df: DataFrame, key: str) -> DataFrame:
    """key, section, case_type, method and confidence of each section of each case."""
    return df.select(key, F.explode(F.transform(F.split("sections", r"\|"), lambda x: x.cast("int"))).alias("section"), "case_type", "method", "confidence")
