"""The type of a case document from its head: the text between title and body, else the head as a whole.

Lines are cut once into an array; where the title ends and where the body begins are positions in that array, found
with array functions. The rules are data, tried in order on a text that is computed once, each where its words are; all
of it stays in Catalyst.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of document types, the first that occurs in the text counts; letter case does not matter.
RULES = [
    (r"appellate\s+body\s+report\s+and\s+panel\s+report", "Appellate_Body_Report_And_Panel_Report"),
    (r"report\s+of\s+the\s+appellate\s+body", "Report_Of_Appellate_Body"),
    (r"appellate\s+body\s+report", "Report_Of_Appellate_Body"),
    (r"report\s+of\s+the\s+panel", "Report_Of_Panel"),
    (r"panel\s+report", "Report_Of_Panel"),
    (r"request\s+for\s+(?:the\s+)?establishment\s+of\s+(?:a\s+)?panel", "Request_For_Establishment_Of_Panel"),
    (r"acceptance\s+.*\s+to\s+join\s+(?:further\s+)?consultations?", "Request_To_Join_Consultations"),
    (r"acceptance\s+.*\s+requests?\s+to\s+join\s+consultations?", "Request_To_Join_Consultations"),
    (r"requests?\s+to\s+join\s+(?:the\s+)?consultations?", "Request_To_Join_Consultations"),
    (r"request\s+(?:to|for)\s+join(?:ing)?\s+(?:the\s+)?consultations?", "Request_To_Join_Consultations"),
    (r"request\s+for\s+consultations?\s+(?:by|from)\s+", "Request_For_Consultations"),
    (r"request\s+for\s+consultations?", "Request_For_Consultations"),
    (r"request\s+(?:for|to)\s+reactivat(?:e|ion)\s+(?:of\s+)?consultations?", "Request_To_Reactivate_Consultations"),
    (r"request\s+for\s+arbitration", "Request_For_Arbitration"),
    (r"request\s+(?:by|from)\s+.+?\s+for\s+arbitration", "Request_For_Arbitration"),
    (r"request\s+.*\s+regarding\s+consultations?", "Request_Regarding_Consultations"),
    (r"request\s+(?:by|from)\s+\w+\s+for\s+(?:the\s+)?establishment", "Request_For_Establishment_Of_Panel"),
    (r"request\s+(?:by|from)\s+.+?\s+for\s+(?:a\s+)?decision", "Request_For_Decision"),
    (r"joint\s+request\s+.*\s+for\s+(?:a\s+)?decision", "Request_For_Decision"),
    (r"notification\s+of\s+(?:an?\s+)?appeal\s+(?:by|from)\s+", "Notification_Of_Appeal"),
    (r"notification\s+of\s+(?:an?\s+)?appeal", "Notification_Of_Appeal"),
    (r"notification\s+of\s+(?:a\s+)?mutually[\s-]agreed\s+solution", "Notification_Of_Mutually_Agreed_Solution"),
    (r"notification\s+of\s+(?:a\s+)?mutually\s+satisfactory", "Notification_Of_Mutually_Agreed_Solution"),
    (r"mutually\s+accept(?:able|ed)\s+solution", "Notification_Of_Mutually_Agreed_Solution"),
    (r"notification\s+of\s+an?\s+understanding", "Notification_Of_Understanding"),
    (r"notification\s+of\s+(?:an?\s+)?agreement", "Notification_Of_Agreement"),
    (r"note\s+by\s+the\s+secretariat", "Note_By_Secretariat"),
    (r"communication\s+from\s+the\s+director[\s-]general", "Communication"),
    (r"report\s+by\s+the\s+director[\s-]general", "Report_By_Director_General"),
    (r"communication\s+(?:from|by)\s+", "Communication"),
    (r"constitution\s+of\s+the\s+panel", "Panel_Composition"),
    (r"composition\s+of\s+the\s+panel", "Panel_Composition"),
    (r"award\s+of\s+the\s+arbitrator", "Arbitration_Award"),
    (r"decision\s+(?:by|of)\s+(?:the\s+)?arbitrator", "Arbitration_Award"),
    (r"decision\s+by\s+arbitrators?", "Arbitration_Award"),
    (r"arbitration\s+(?:award|report|decision)", "Arbitration"),
    (r"appointment\s+of\s+(?:the\s+)?arbitrator", "Appointment_Of_Arbitrator"),
    (r"constitution\s+of\s+(?:the\s+)?arbitrator", "Constitution_Of_Arbitrator"),
    (r"recourse\s+(?:by\s+.+?\s+)?to\s+article\s+(?:21\.5|22\.6|22|25|4)", "Recourse"),
    (r"objection\s+.*\s+to\s+recourse", "Objection_To_Recourse"),
    (r"status\s+report", "Status_Report"),
    (r"working\s+procedures", "Working_Procedures"),
    (r"(?:additional|supplementary)\s+procedures?", "Additional_Procedures"),
    (r"agreed\s+procedures", "Agreed_Procedures"),
    (r"procedural\s+agreement", "Agreed_Procedures"),
    (r"agreement\s+on\s+procedures", "Agreed_Procedures"),
    (r"suspension\s+of\s+(?:panel\s+)?proceedings", "Suspension_Of_Proceedings"),
    (r"suspension\s+of\s+(?:concessions|obligations)", "Suspension_Of_Concessions"),
    (r"resumption\s+of\s+(?:panel\s+)?proceedings", "Resumption_Of_Proceedings"),
    (r"action\s+by\s+the\s+dispute\s+settlement\s+body", "DSB_Action"),
    (r"surveillance\s+of\s+implementation", "Surveillance_Of_Implementation"),
    (r"implementation\s+of\s+(?:the\s+)?recommendations", "Implementation_Report"),
    (r"agreement\s+under\s+article\s+21\.3", "Agreement_Art_21_3"),
    (r"understanding\s+(?:between|on|regarding)", "Understanding"),
    (r"extension\s+of\s+(?:the\s+)?(?:time\s+)?period", "Extension_Of_Time_Period"),
    (r"proposed\s+modification", "Proposed_Modification"),
    (r"terms\s+of\s+reference", "Terms_Of_Reference"),
    (r"withdrawal\s+of", "Withdrawal"),
    (r"erroneously\s+published.*cancelled", "Cancelled_Document"),
    (r"document.*cancelled", "Cancelled_Document"),
    (r"executive\s+summary", "Executive_Summary"),
    (r"third[\s-]party\s+(?:submission|communication)", "Submission"),
    (r"first\s+(?:written\s+)?submissions?\s+(?:by|of)\s+(?:the\s+)?parties", "Submission"),
    (r"second\s+(?:written\s+)?submissions?\s+(?:by|of)\s+(?:the\s+)?parties", "Submission"),
    (r"oral\s+statements?", "Submission"),
    (r"statement\s+(?:by|from)\s+", "Statement"),
    (r"questions?\s+and\s+(?:answers?|replies)", "Questions_And_Replies"),
    (r"replies?\s+(?:from|by)\s+", "Questions_And_Replies"),
    (r"transcript\s+of\s+(?:the\s+)?proceedings", "Transcript"),
    (r"interim\s+review", "Interim_Review"),
    (r"modification\s+of", "Modification"),
    (r"addendum", "Addendum"),
    (r"corrigendum", "Corrigendum"),
]
#: How the first line of a body begins, whatever the letter case, and with it.
BODY = r"(?i)^(?:The following\s|Pursuant\s|At its meeting|This (?:addendum|report|document)|The report of the)"
BODY_CASED = r"^(?:_{3,}|\d+\.?\s+[A-Z]|I\.\s)"
DASH = "[–—-]"
#: Characters of the head, and of it where nothing stands between title and body; lines after a title
#: that may go on with it, and lines before the body.
HEAD, WHOLE, MORE_TITLE, BEFORE_BODY = 2000, 1200, 3, 15
UNKNOWN = "UNKNOWN"
#: White space beyond that of regular expressions here, all read as blanks.
OTHER_SPACE = "\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def capitals(line: Column) -> Column:
    """Whether a line is in capitals, or more than half of its more than five characters are."""
    some = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    return ((some > 0) & ~line.rlike(r"[\p{Ll}\p{Lt}]")) | ((F.length(line) > 5) & (some > 0.5 * F.length(line)))


def plain_space(text: Column) -> Column:
    return F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE))


def head_lines(text: Column) -> Column:
    """The lines of a text's head, stripped."""
    lines = F.split(plain_space(F.substring(text, 1, HEAD)), "\n", -1)
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def with_before_body(df: DataFrame) -> DataFrame:
    """df with _between, the text between title and body, from _lines as head_lines gives them.

    The title is the first line in capitals of ten characters or more with a dash, and up to MORE_TITLE lines in
    capitals after it; without one the text begins with the head. Blank lines do not count. Each position is a column,
    so that it is found once.
    """
    title, more, rest, stop = map(F.col, held := ("_title", "_more", "_rest", "_stop"))
    rows = df.withColumn("_title", F.array_position(F.transform("_lines", lambda x: (F.length(x) >= 10) & x.rlike(DASH) & capitals(x)), True).cast("int"))
    caps = F.transform(F.slice("_lines", title + 1, MORE_TITLE), capitals)
    rows = rows.withColumn("_more", caps).withColumn("_more", F.struct(F.size(more).alias("n"), F.array_position(more, False).cast("int").alias("end")))
    goes_on = F.when(title == 0, 0).when(more["end"] == 0, more["n"]).otherwise(more["end"] - 1)
    rows = rows.withColumn("_rest", F.slice("_lines", title + goes_on + 1, BEFORE_BODY))
    rows = rows.withColumn("_stop", F.array_position(F.transform(rest, lambda x: x.rlike(BODY) | x.rlike(BODY_CASED)), True).cast("int"))
    kept = F.when(stop == 0, rest).otherwise(F.slice(rest, 1, F.greatest(stop - 1, F.lit(0))))
    return rows.withColumn("_between", F.array_join(F.filter(kept, lambda x: x != ""), " ")).drop(*held)


def needed_words(pattern: str) -> list[str]:
    """Words in small letters that occur in whatever the pattern meets, longest first; the pattern has no choice outside
    of brackets."""
    while (bare := re.sub(r"\((?:\?:)?[^()]*\)[?*+]*", " ", pattern)) != pattern:
        pattern = bare
    bare = re.sub(r"\[[^]]*\]|\\.|.[?*]", " ", pattern)
    return sorted(set(re.findall("[a-z]+", bare)), key=lambda w: (-len(w), w))


def first_rule(text: Column, small: Column) -> Column:
    """The number of the first rule that occurs in text, from 1; null if none does. small is text in small letters: a
    pattern is tried only where its two longest words are, as most texts have the words of few rules."""
    there = [reduce(and_, (F.contains(small, F.lit(w)) for w in needed_words(p)[:2])) for p, _ in RULES]
    return F.coalesce(*(F.when(here & text.rlike(f"(?is){p}"), k) for k, (here, (p, _)) in enumerate(zip(there, RULES), 1)))


def met_by(text: Column, rule: Column) -> Column:
    """The part of text that a rule meets."""
    pattern = F.element_at(F.array(*(F.lit(f"(?is){p}") for p, _ in RULES)), rule)
    return F.regexp_replace(F.regexp_substr(text, pattern), r"^\s+|\s+$", "")


def with_doc_type(df: DataFrame, text: str, doc_type: str = "doc_type", raw: str = "doc_type_raw") -> DataFrame:
    """df with the type of the document and what it was taken from. A null text is UNKNOWN, from an empty one."""
    given = F.coalesce(F.col(text), F.lit(""))
    rows = with_before_body(df.withColumn("_lines", head_lines(given))).drop("_lines")
    near = rows.withColumn("_small", F.lower("_between")).withColumn("_near", first_rule(F.col("_between"), F.col("_small")))
    whole = F.regexp_replace(plain_space(F.substring(given, 1, WHOLE)), r"\s+", " ")
    found = near.withColumn("_whole", F.when(F.col("_near").isNull(), whole)).withColumn("_small", F.lower("_whole")).withColumn("_far", first_rule(F.col("_whole"), F.col("_small")))
    rows = found.withColumn("_rule", F.coalesce("_near", "_far", F.lit(0)))
    kind = F.element_at(F.array(F.lit(UNKNOWN), *(F.lit(k) for _, k in RULES)), F.col("_rule") + 1)
    met = F.when(F.col("_far").isNotNull(), met_by(F.col("_whole"), F.col("_rule"))).otherwise(F.col("_between"))
    return rows.withColumns({doc_type: kind, raw: met}).drop("_between", "_near", "_small", "_whole", "_far", "_rule")
