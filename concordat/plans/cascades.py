"""Authors and sections by cascades of rules; the SQL knows the answers from how the rows are put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import cascades
from concordat.plans.catalog import query
from concordat.sources.views import table

#: Types with a rule, those that the text tells, and one of neither.
TYPES = [*cascades.AUTHORS, "Communication", "Status_Report", "Addendum", "Executive_Summary", "Submission", "Statement", "Withdrawal"]
_TYPE = "CASE CAST(doc_id % " + str(len(TYPES)) + " AS INT) " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES)) + " END"
_LAYOUT = f"CAST(floor(doc_id / {len(TYPES)}) % 7 AS INT)"
RAW = f"CASE {_LAYOUT} WHEN 0 THEN 'Communication from the Permanent Mission of Utopia to the Secretariat' WHEN 1 THEN 'Communication by the Kingdom of Erewhon, under Article 6' WHEN 4 THEN 'Submissions of the third parties Page' WHEN 6 THEN 'Communication from Atlantis' ELSE 'Something else' END"
HEAD = f"concat(CASE {_LAYOUT} WHEN 2 THEN 'Sent BY the Lilliput. Addendum' WHEN 3 THEN 'Submission of Laputa; Contents' ELSE '' END, rpad('', 500, ' x'), text)"


@query(
    f"""SELECT doc_id, CASE WHEN kind IS NOT NULL THEN kind WHEN v = 0 THEN 'complainant' WHEN v = 1 THEN 'respondent' WHEN v IN (2, 6) OR submitted THEN 'third_party' ELSE 'unknown' END AS author,
       CASE WHEN kind IN ('panel', 'secretariat', 'arbitrator') THEN concat(upper(kind[1]), kind[2:]) WHEN kind = 'appellate_body' THEN 'Appellate Body' WHEN kind = 'complainant' THEN 'Utopia' WHEN kind = 'joint' THEN 'Utopia & Kingdom of Erewhon'
         WHEN v = 0 THEN 'Utopia' WHEN v = 1 THEN 'Kingdom of Erewhon' WHEN v = 2 THEN 'Lilliput' WHEN v = 6 THEN 'Atlantis' WHEN kind = 'third_party' THEN 'Third Party' WHEN submitted THEN CASE v WHEN 3 THEN 'Laputa' ELSE 'Third Parties' END ELSE 'Unknown' END AS author_name,
       CASE WHEN kind IS NOT NULL OR v IN (0, 1, 6) THEN 'high' WHEN v = 2 OR submitted THEN 'medium' ELSE 'low' END AS author_confidence,
       CASE WHEN kind IS NOT NULL THEN 'rule' WHEN v IN (0, 1, 6) THEN 'raw_extract' WHEN v = 2 OR submitted THEN 'text_extract' ELSE 'external' END AS author_stage
       FROM (SELECT doc_id, {_LAYOUT} AS v, CASE {_TYPE} {" ".join(f"WHEN '{t}' THEN '{k}'" for t, (k, _) in cascades.AUTHORS.items())} END AS kind,
         {_TYPE} IN ('Addendum', 'Executive_Summary', 'Submission') AND {_LAYOUT} IN (3, 4) AS submitted FROM documents)"""
)
def doc21_author(s, d):
    """Every type in seven layouts of what names the author."""
    parties = {"cs": "array('Utopia')", "rs": "array('Kingdom of Erewhon')", "ts": "array('Lilliput', 'Laputa')"}
    rows = table(s, d, "documents").select("doc_id", F.expr(_TYPE).alias("doc_type"), F.expr(RAW).alias("raw"), F.expr(HEAD).alias("head"), *(F.expr(x).alias(c) for c, x in parties.items()))
    found = cascades.with_author(rows, "doc_type", "raw", "head", "cs", "rs", "ts", {})
    return found.select("doc_id", "author", "author_name", "author_confidence", "author_stage")


#: Codes with and without points, none, of no chapter; what a model found and what the title tells, or null.
_CODES = "CASE p_partkey % 4 WHEN 0 THEN concat(p_size + 10, '.01| HS ', p_size + 40, '|NAN') WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE NULL END"
_FOUND = ("CASE WHEN p_partkey % 3 = 0 THEN {0}p_size % 25, 3, p_size % 5{1} WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN {0}0, 22{1} END", "CASE p_size % 3 WHEN 0 THEN 'policy' ELSE 'product' END")
_TITLE = ("CASE WHEN p_size % 7 > 1 THEN {0}p_size % 21 + 1{1} WHEN p_size % 7 = 1 THEN {0}99{1} END", "'product'")
_SECTION = """(CASE WHEN c BETWEEN 1 AND 5 THEN 1 WHEN c <= 14 THEN 2 WHEN c = 15 THEN 3 WHEN c <= 24 THEN 4 WHEN c <= 27 THEN 5 WHEN c <= 38 THEN 6 WHEN c <= 40 THEN 7 WHEN c <= 43 THEN 8 WHEN c <= 46 THEN 9 WHEN c <= 49 THEN 10 WHEN c <= 63 THEN 11 WHEN c <= 67 THEN 12
    WHEN c <= 70 THEN 13 WHEN c = 71 THEN 14 WHEN c <= 83 THEN 15 WHEN c <= 85 THEN 16 WHEN c <= 89 THEN 17 WHEN c <= 92 THEN 18 WHEN c = 93 THEN 19 WHEN c <= 96 THEN 20 WHEN c = 97 THEN 21 END)"""
_RESOLVED = f"""resolved AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN p_partkey % 4 = 0 THEN codes WHEN found IS NOT NULL THEN CASE WHEN len(f) > 0 THEN f ELSE range(1, 22) END WHEN len(t) > 0 THEN t ELSE range(1, 22) END)), '|') AS sections,
    CASE WHEN p_partkey % 4 = 0 THEN 'product' WHEN found IS NOT NULL THEN found_kind WHEN len(t) > 0 THEN 'product' ELSE 'policy' END AS case_type,
    CASE WHEN p_partkey % 4 = 0 THEN 'explicit_hs' WHEN found IS NOT NULL THEN 'model' ELSE 'title_fallback' END AS method,
    CASE WHEN p_partkey % 4 = 0 THEN 'high' WHEN found IS NULL THEN 'low' WHEN found_kind = 'product' AND len(f) > 0 THEN 'high' ELSE 'medium' END AS confidence
    FROM (SELECT p_partkey, found, found_kind, list_filter(found, lambda x: x BETWEEN 1 AND 21) AS f, list_filter(title, lambda x: x BETWEEN 1 AND 21) AS t, list_transform([p_size + 10, p_size + 40], lambda c: {_SECTION}) AS codes
      FROM (SELECT p_partkey, p_size, {_FOUND[0].format("[", "]")} AS found, {_FOUND[1]} AS found_kind, {_TITLE[0].format("[", "]")} AS title FROM part)))"""


def _sections(s, d):
    rows = table(s, d, "part").select("p_partkey", F.expr(_CODES).alias("codes"), F.expr(_FOUND[0].format("array(", ")")).alias("found"), F.expr(_FOUND[1]).alias("found_kind"), F.expr(_TITLE[0].format("array(", ")")).alias("title"), F.expr(_TITLE[1]).alias("title_kind"))
    return cascades.with_sections(rows, "codes", "found", "found_kind", "title", "title_kind")


@query(", " + _RESOLVED + " SELECT * FROM resolved")
def doc26_sections(s, d):
    return _sections(s, d).select("p_partkey", "sections", "case_type", "method", "confidence")


@query(", " + _RESOLVED + " SELECT p_partkey, CAST(unnest(string_split(sections, '|')) AS INT) AS section, case_type, method, confidence FROM resolved")
def doc26_one_row_a_section(s, d):
    return cascades.one_row_a_section(_sections(s, d), "p_partkey")


@query(f"SELECT p_partkey, {_SECTION} AS section FROM (SELECT p_partkey, p_size + CAST(p_partkey % 50 AS INT) AS c FROM part)")
def str15_sections_21(s, d):
    """The 21 sections by all chapters."""
    return table(s, d, "part").select("p_partkey", cascades.chapter_section(F.lpad((F.col("p_size") + F.col("p_partkey") % 50).cast("string"), 2, "0")).alias("section"))
