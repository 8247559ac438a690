"""Labels of case documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import cleaning, doctypes, documents, labels
from concordat.plans.catalog import _MARKS, _line_words, query
from concordat.plans.cleaning import _blank, _even
from concordat.sources.views import table

#: Codes of every kind, of none, and twice the same agreement.
CODES = "['WT/DS1/R', concat(CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'G/SPS/' WHEN 1 THEN 'IP/D/' WHEN 2 THEN 'G/L/' WHEN 3 THEN 'G/LIC/' WHEN 4 THEN 'S/L/' ELSE 'X/' END, doc_id), concat(CASE WHEN doc_id % 3 = 0 THEN 'G/SPS/' ELSE 'G/ADP/' END, doc_id)]"
PREFIXES = ", ".join(f"{{'p': '{p}', 'name': '{n}'}}" for p, n in labels.AGREEMENTS.items())


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter([{PREFIXES}], lambda x: len(list_filter({CODES}, lambda c: starts_with(c, x.p))) > 0), lambda x: x.name))), '; ') AS agreements FROM documents")
def doc04_agreements(s, d):
    codes = F.expr("array" + CODES.replace("[", "(").replace("]", ")"))
    return table(s, d, "documents").select("doc_id", F.array_join(labels.agreements(codes), "; ").alias("agreements"))


#: Texts whose head has all that goes, and whose rest repeats it.
HEADED = """concat('World  Trade', chr(10), ' Organization', chr(10), 'WT/DS', doc_id, '/R g/sps/n/12 S/L/7/Add.1 IP/D/3', chr(10), '(97-', 1000 + doc_id % 9000, ') Page: 1/22', chr(10), ' 7 march 1999 ', chr(10),
    'Original: English/french', chr(10), 'on 7 March 1999 it was', chr(10), CASE WHEN doc_id % 2 = 0 THEN 'logo: World Trade Organization, blue' ELSE 'Analysis : of it' END, chr(10), 'more', chr(10), chr(10), '<!-- a', chr(10), 'b -->', text,
    CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'Analysis: the end') ELSE '' END)"""


def _headless(x):
    for p in labels.HEADER:
        x = f"regexp_replace({x}, '(?ism){p}', '{chr(92) + '1' if '(' + chr(92) + 'n' + chr(92) + 'n)' in p else ''}', 'g')"
    return x


@query(f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, concat({_headless(f'substr(h, 1, 2000)')}, substr(h, 2001)) AS x FROM (SELECT doc_id, {HEADED} AS h FROM documents))")
def doc08_without_header(s, d):
    x = table(s, d, "documents").select("doc_id", F.expr(HEADED).alias("h")).select("doc_id", labels.without_header(F.col("h")).alias("x"))
    return x.select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


KINDS = [*labels.CLASS_TYPES, "OTHER"]
CLASS = "CASE CAST(doc_id % 17 AS INT) " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
VARIANT = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Add' WHEN 1 THEN 'Corr' WHEN 2 THEN 'Rev' WHEN 3 THEN '' END"


def _case(x, names):
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(f"SELECT doc_id, COALESCE({_case(f'({CLASS})', labels.CLASS_TYPES)}, {_case(f'({VARIANT})', labels.VARIANT_TYPES)}, 'UNKNOWN') AS doc_type FROM documents")
def doc16_fallback_type(s, d):
    return table(s, d, "documents").select("doc_id", labels.fallback_type(F.expr(CLASS), F.expr(VARIANT)).alias("doc_type"))


JOIN_TYPE = "CASE WHEN doc_id % 4 = 0 THEN 'Request_To_Join_Consultations' WHEN doc_id % 4 = 1 THEN 'joining' WHEN doc_id % 4 = 2 THEN 'Report_Of_Panel' END"
FIRST_PAGE = """concat(CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('A Communication  from', chr(10), 'Nation ', doc_id, ' The following, ') WHEN 1 THEN concat('Request to join the consultations by Land ', doc_id, ' the following. ')
    WHEN 2 THEN concat('communication from Isle ', doc_id, ', dated ') WHEN 3 THEN 'Joining consultation from X1 the  following: ' ELSE '' END, text)"""


@query(
    "SELECT doc_id, CASE WHEN contains(lower(doc_type), 'join') THEN COALESCE(NULLIF(trim(regexp_extract(page, '{}', 1)), ''), NULLIF(trim(regexp_extract(page, '{}', 1)), ''), NULLIF(trim(regexp_replace(trim(regexp_extract(page, '{}', 1)), '(?i)\\s+the\\s+following.*$', '')), ''), 'UNKNOWN') END AS joiner".format(*labels.JOINERS)
    + f" FROM (SELECT doc_id, {JOIN_TYPE} AS doc_type, regexp_replace(substr({FIRST_PAGE}, 1, 1500), '\\s+', ' ', 'g') AS page FROM documents)"
)
def doc19_joiner(s, d):
    return table(s, d, "documents").select("doc_id", labels.joiner(F.expr(JOIN_TYPE), F.expr(FIRST_PAGE)).alias("joiner"))


PARTY_ALIASES = {"party of one": "nation <1>", "the five": "nation <5>"}
ENTITY = """CASE CAST(case_id % 9 AS INT) WHEN 0 THEN 'the Chairman of the Panel' WHEN 1 THEN 'Appellate Body' WHEN 2 THEN 'The Arbitrators,' WHEN 3 THEN 'Director-General' WHEN 4 THEN concat('The Nation <', case_id % 25, '>.')
    WHEN 5 THEN 'Party of One' WHEN 6 THEN 'The Far Isles;' WHEN 7 THEN concat('Delegation of Nation <', case_id % 25, '>') ELSE 'xy' END"""
_NORMAL = "trim(regexp_replace(regexp_replace(lower(trim({0})), '^the ', ''), '[,;:!*]+$', ''))"


def _known(x):
    pairs = [_case(y, PARTY_ALIASES) for y in (x, f"regexp_replace({x}, '\\.$', '')", f"concat({x}, '.')")]
    return f"COALESCE({', '.join(pairs)}, {x})"


def _first(role):
    p = _known(_NORMAL.format("p"))
    return f"list_filter({role}, lambda p: e = {p} OR contains(e, {p}) OR contains({p}, e))[1]"


@query(
    f"""SELECT case_id, entity, CASE WHEN contains(n, 'panel') THEN 'panel' WHEN contains(n, 'appellate body') THEN 'appellate_body' WHEN contains(n, 'arbitrator') THEN 'arbitrator' WHEN contains(n, 'director-general') THEN 'secretariat'
         WHEN c IS NOT NULL THEN 'complainant' WHEN r IS NOT NULL THEN 'respondent' WHEN length(bare) > 2 THEN 'third_party' ELSE 'unknown' END AS kind,
       CASE WHEN contains(n, 'panel') THEN 'Panel' WHEN contains(n, 'appellate body') THEN 'Appellate Body' WHEN contains(n, 'arbitrator') THEN 'Arbitrator' WHEN contains(n, 'director-general') THEN 'Secretariat'
         ELSE COALESCE(c, r, tp, CASE WHEN length(bare) > 2 THEN bare ELSE entity END) END AS name
       FROM (SELECT case_id, entity, n, bare, CASE WHEN length(e) >= 3 THEN {_first('cs')} END AS c, CASE WHEN length(e) >= 3 THEN {_first('rs')} END AS r, CASE WHEN length(e) >= 3 THEN {_first('ts')} END AS tp
       FROM (SELECT *, {_known('n')} AS e FROM (SELECT *, {_NORMAL.format('entity')} AS n, trim(regexp_replace(regexp_replace(trim(entity), '(?i)^the\\s+', ''), '[.,;:]+$', '')) AS bare
       FROM (SELECT case_id, {ENTITY} AS entity, """
    + ", ".join(f"COALESCE(list_sort(list(concat('Nation <', party, '>')) FILTER (role = '{role}')), []) AS {name}" for role, name in (("complainant", "cs"), ("respondent", "rs"), ("third_party", "ts")))
    + " FROM v_case_party GROUP BY case_id))))"
)
def doc22_authoring_party(s, d):
    name = F.concat(F.lit("Nation <"), F.col("party").cast("string"), F.lit(">"))
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, name))).alias(role)
    cases = table(s, d, "v_case_party").groupBy("case_id").agg(of("complainant"), of("respondent"), of("third_party")).withColumn("entity", F.expr(ENTITY))
    found = labels.authoring_party(F.col("entity"), F.col("complainant"), F.col("respondent"), F.col("third_party"), PARTY_ALIASES)
    return cases.select("case_id", "entity", found.alias("f")).select("case_id", "entity", "f.kind", "f.name")


@query("SELECT doc_id, COALESCE('severity ' || severity, '') AS summary, COALESCE(date_text, '') AS date_text FROM documents LEFT JOIN v_case ON case_id = doc_id AND case_id % 3 <> 0")
def src17_case_metadata(s, d):
    """Names of cases without a number belong to no document."""
    case = F.when(F.col("case_id") % 3 != 0, F.concat(F.lit("case DS"), F.col("case_id").cast("string"))).otherwise("withdrawn")
    cases = table(s, d, "v_case").select(case.alias("case"), F.concat(F.lit("severity "), F.col("severity").cast("string")).alias("summary"), "date_text")
    return labels.with_case_metadata(table(s, d, "documents").select("doc_id"), "doc_id", cases, "case", ["summary", "date_text"])


FRONT = """concat(' WORLD  TRADE', chr(10), 'WT/DS', doc_id, '/R', chr(10), '7 March 1999', chr(10), 'Original: English', chr(10), CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'BRAZIL – MEASURES ON TYRES' WHEN 1 THEN ' EC - Xy BANANAS AND THE REST '
    WHEN 2 THEN 'Japan - taxes on drinks' WHEN 3 THEN 'KOREA-TAX' ELSE concat('CANADA — PATENT TERM ', doc_id) END, chr(10), CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('Page: 1/9', chr(10), 'AND OTHER  GOODS', chr(10), 'OF IT') WHEN 2 THEN 'Report' ELSE 'RECOURSE BY INDIA' END,
    chr(10), CASE WHEN doc_id % 2 = 0 THEN 'SECOND - TITLE LINE' ELSE '' END, chr(10), text)"""


@query(
    f"""SELECT doc_id, COALESCE(string_agg(x, ' ' ORDER BY i) FILTER (body AND i >= start AND i < stop), '') AS title FROM (
       SELECT *, MIN(i) FILTER (i >= start AND (x = '' OR NOT (heading OR body))) OVER (PARTITION BY doc_id) AS first_end, COALESCE(first_end, 9999) AS stop FROM (
       SELECT *, MIN(i) FILTER (body AND length(x) > 10 AND regexp_matches(x, '[–—-]')) OVER (PARTITION BY doc_id) AS start FROM (
       SELECT *, NOT heading AND length(x) > 5 AND ((upper(x) = x AND lower(x) <> x) OR length(regexp_replace(x, '\\P{{Lu}}', '', 'g')) > 0.6 * length(x)) AS body FROM (
       SELECT doc_id, i, x, regexp_matches(x, '(?i)^(WORLD\\s+TRADE|ORGANIZATION|ORGANISATION|ORGANIZACIÓN|Original:|Page:)') OR regexp_matches(x, '^(WT/|G/|S/L/|IP/|\\d{{1,2}}\\s+\\w+\\s+\\d{{4}}|\\(\\d{{2}}-\\d{{4,5}}\\))') AS heading FROM (
       SELECT doc_id, generate_subscripts(l, 1) AS i, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT doc_id, string_split(substr({FRONT}, 1, 1500), chr(10)) AS l FROM documents)))))) GROUP BY doc_id"""
)
def doc06_case_title(s, d):
    return table(s, d, "documents").select("doc_id", labels.case_title(F.expr(FRONT)).alias("title"))


NOTED = """concat(CASE WHEN doc_id % 3 = 0 THEN concat('____', chr(10)) ELSE '' END, text, chr(10), ' _____ ', chr(10), '1 See it,', chr(10), 'and more', chr(10), chr(10), ' ', chr(10), '22. Ibid.', chr(10), CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Body goes on' WHEN 1 THEN concat(chr(10), 'body after a gap') WHEN 2 THEN '___'
    WHEN 3 THEN concat('___ no rule', chr(10), 'A', chr(10), '___', chr(10), '___', chr(10), '7', chr(10), '8 ') ELSE concat(chr(10), chr(10)) END, chr(10), text, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), '_______', chr(10), '3) end') ELSE '' END)"""
_RULE = r"[^\S\n]*_{3,}[^\S\n]*"
_NOTE = r"(?:\n(?:[^\S\n]*\n)*[^\S\n]*\d{1,3}(?:[.)][^\n]*|[^\S\n]+\S[^\n]*)(?:\n[^\S\n]*[^\s\p{Lu}][^\n]*)*)*"


@query(f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, substr(regexp_replace(concat(chr(10), {NOTED}), '(?:\\n{_RULE}{_NOTE})+(\\n|$)', '\\1', 'g'), 2) AS x FROM documents)")
def doc11_without_footnotes(s, d):
    x = table(s, d, "documents").select("doc_id", labels.without_footnotes(F.expr(NOTED)).alias("x"))
    return x.select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


NAMED = """SELECT conv_id AS case_number, CAST(turn * 10 + ascii(role) % 7 AS INT) AS seq, role AS doc_type, CASE CAST((conv_id + turn) % 4 AS INT) WHEN 0 THEN 'Add' WHEN 1 THEN '' END AS variant,
    CAST(turn AS INT) AS variant_number, CAST(CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN turn + 1 END AS INT) AS part_number FROM """


@query(
    f"""SELECT case_number, seq, concat('DS', case_number, '_SEQ', format('{{:02d}}', seq), '_', doc_type, CASE WHEN variant <> '' THEN concat('_', variant, CASE WHEN variant_number > 1 THEN CAST(variant_number AS VARCHAR) ELSE '' END) ELSE '' END,
       COALESCE(format('_{{:02d}}', part_number), ''), CASE WHEN plain AND n > 1 THEN format('_{{:02d}}', earlier) ELSE '' END, '.pdf') AS new_name
       FROM (SELECT *, COUNT(*) FILTER (plain) OVER w AS n, COUNT(*) FILTER (plain) OVER (w ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
       FROM (SELECT *, COALESCE(variant, '') = '' AND part_number IS NULL AS plain FROM ({NAMED} (SELECT DISTINCT conv_id, turn, role FROM conversations))) WINDOW w AS (PARTITION BY case_number, doc_type))"""
)
def doc18_semantic_names(s, d):
    turns = table(s, d, "conversations").select("conv_id", "turn", "role").distinct()
    return labels.semantic_names(s.sql(NAMED + "{turns}", turns=turns)).select("case_number", "seq", "new_name")


#: A phrase for each rule of document types, which that rule, or an earlier one of the same type, meets as a whole.
PHRASES = """appellate body report and panel report; report of the appellate body; appellate body report; report of the panel; panel report; request for the establishment of a panel;
    acceptance of the wish to join further consultations; acceptance of requests to join consultations; requests to join the consultations; request for joining consultations; request for consultations by;
    request for consultations; request to reactivate consultations; request for arbitration; request by Utopia for arbitration; request of Utopia regarding consultations; request by Utopia for the establishment;
    request from New Utopia for a decision; joint request of both for a decision; notification of an appeal by; notification of appeal; notification of a mutually-agreed solution; notification of mutually satisfactory;
    mutually acceptable solution; notification of an understanding; notification of agreement; note by the secretariat; communication from the director-general; report by the director-general; communication from;
    constitution of the panel; composition of the panel; award of the arbitrator; decision of the arbitrator; decision by arbitrator; arbitration award; appointment of the arbitrator; constitution of the arbitrator;
    recourse to article 21.5; objection of Utopia to recourse; status report; working procedures; additional procedures; agreed procedures; procedural agreement; agreement on procedures; suspension of proceedings;
    suspension of concessions; resumption of panel proceedings; action by the dispute settlement body; surveillance of implementation; implementation of the recommendations; agreement under article 21.3;
    understanding between; extension of the time period; proposed modification; terms of reference; withdrawal of; erroneously published and cancelled; document now cancelled; executive summary; third-party submission;
    first written submissions by the parties; second submission of parties; oral statement; statement by; questions and replies; replies from; transcript of the proceedings; interim review; modification of; addendum; corrigendum"""
PHRASES = [x.strip() for x in PHRASES.split(";")]
TYPE_TEXT = f"""concat(CASE CAST(doc_id % 5 AS INT)
    WHEN 0 THEN concat('WT/DS1/1', chr(10), 'UTOPIA – MEASURES ON GOODS', chr(10), 'AND SERVICES', chr(10), chr(10), phrase, ' Utopia', chr(10), chr(10), 'The following panel report', chr(10))
    WHEN 1 THEN concat('  UTOPIA - MEASURES', chr(10), substr(phrase, 1, CASE WHEN instr(phrase, ' ') > 0 THEN instr(phrase, ' ') - 1 ELSE length(phrase) END), chr(10), chr(10), substr(phrase, CASE WHEN instr(phrase, ' ') > 0 THEN instr(phrase, ' ') ELSE length(phrase) + 1 END), ' Utopia', chr(10), '___ corrigendum', chr(10))
    WHEN 2 THEN concat(phrase, ' Utopia', chr(10), 'Pursuant to the appellate body report', chr(10))
    WHEN 3 THEN concat('UTOPIA — MEASURES', chr(10), '1. Introduction: the  ', regexp_replace(phrase, ' ', chr(10)), ' Utopia it is')
    ELSE concat(chr(10), 'Some other  thing', chr(10), 'I. The rest', chr(10)) END, rpad('', 2000, 'x '), text)"""


def _chosen(values, quoted="array({})"):
    return quoted.format(", ".join(f"'{x}'" for x in values))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'UNKNOWN' ELSE {_chosen([k for _, k in doctypes.RULES], '[{}]')}[doc_id % 73 + 1] END AS doc_type,
       CASE WHEN doc_id % 5 = 4 THEN 'Some other  thing' WHEN doc_id % 5 = 3 THEN phrase ELSE concat(phrase, ' Utopia') END AS doc_type_raw
       FROM (SELECT doc_id, {_chosen(PHRASES, '[{}]')}[doc_id % 73 + 1] AS phrase FROM documents)"""
)
def doc05_document_type(s, d):
    """Every rule in five layouts; the SQL knows the answers from how the texts are put together, without the patterns."""
    docs = table(s, d, "documents").selectExpr("doc_id", f"element_at({_chosen(PHRASES)}, cast(doc_id % 73 + 1 as int)) AS phrase", "text")
    typed = doctypes.with_doc_type(docs.select("doc_id", F.expr(TYPE_TEXT).alias("page")), "page")
    return typed.select("doc_id", "doc_type", "doc_type_raw")


#: Pages with all that goes: header, headings, codes, markers, page numbers, notes, other languages and titles again.
PAGES = f"""concat({HEADED}, chr(10), 'LAND X - MEASURES ON GOODS', chr(10), 'WORLD TRADE ORGANIZATION', chr(10), '  ORGANIZATION 7 March 1999 ', chr(10), 'ORGANIZATION  LAND X – GOODS', chr(10), 'ORGANIZATION of it', chr(10), 'WT/DS', doc_id, '/R', chr(10),
    '[WT/DS27, WT/DS361 and WT/L/625]', chr(10), '[WT/DS27, see]', chr(10), '(anglais)', chr(10), ' - 4 - ', chr(10), 'Body  text', chr(10), chr(10), 'les mesures sont dans cette page pour une fois', chr(10), 'Land X - measures   on goods again', chr(10), '. ; ,', chr(10),
    '____', chr(10), '1 See it,', chr(10), 'and more', chr(10), chr(10), 'Body goes on', chr(10), 'Page 12', chr(10), text, chr(10), 'LAND X - MEASURES ON GOODS ')"""
_TITLE = "LAND X - MEASURES ON GOODS"
_AGAIN = "(?i)LAND\\s+X\\s+-\\s+MEASURES\\s+ON\\s+GOODS"
_FOREIGN = f"""array_to_string(list_filter(string_split(x, chr(10)), lambda line: len({_line_words("line")}) < 5 OR len(list_filter({_line_words("line")}, lambda w: list_contains({_MARKS}, w))) < 0.2 * len({_line_words("line")})), chr(10))"""


@query(
    f"""SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {_even(_blank("x", cleaning.NOISE_LINE))} AS x FROM (
       SELECT doc_id, CASE WHEN strpos(x, '{_TITLE}') > 0 THEN concat(substr(x, 1, strpos(x, '{_TITLE}') + 25), regexp_replace(substr(x, strpos(x, '{_TITLE}') + 26), '{_AGAIN}', '', 'g')) ELSE x END AS x FROM (
       SELECT doc_id, {_FOREIGN} AS x FROM (
       SELECT doc_id, substr(regexp_replace(concat(chr(10), x), '(?:\\n{_RULE}{_NOTE})+(\\n|$)', '\\1', 'g'), 2) AS x FROM (
       SELECT doc_id, {_blank("x", cleaning.BRACKETED_LINE, cleaning.LANGUAGE_LINE, cleaning.PAGE_LINE)} AS x FROM (
       SELECT doc_id, regexp_replace({_blank("x", cleaning.HEADING_LINE, cleaning.DATED_LINE)}, '{cleaning.BEFORE_TITLE}', '\\1\\2', 'g') AS x FROM (
       SELECT doc_id, concat({_headless("substr(h, 1, 2000)")}, substr(h, 2001)) AS x FROM (SELECT doc_id, {PAGES} AS h FROM documents))))))))"""
)
def doc14_all_steps(s, d):
    """All ten steps of the clean-up, one after another."""
    rows = table(s, d, "documents").select("doc_id", F.expr(PAGES).alias("text")).withColumn("title", F.lit(_TITLE))
    return cleaning.clean_steps(rows, "text", "title").select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


#: Files of original documents: numbered ones, reports of four kinds and others, in parts and variants.
FILES = """SELECT case_number, CASE v WHEN 0 THEN concat(case_number, '-', n, CASE WHEN turn % 2 = 0 THEN 'A' ELSE '' END, turn, '.pdf') WHEN 1 THEN concat(case_number, 'RW', n, '-', turn, '.pdf') WHEN 2 THEN concat(case_number, 'ABRA', n, '-', turn, '.pdf')
        WHEN 3 THEN concat(case_number, 'R-', turn, '.pdf') ELSE concat('D', case_number, '-', n, '-', turn, '.pdf') END AS original_filename,
    concat('N', conv_id, '_', turn) AS new_filename, concat('T', v) AS doc_type, CASE v WHEN 0 THEN 'NUMBERED' WHEN 1 THEN 'RECOURSE' WHEN 2 THEN 'AB_REPORT' WHEN 3 THEN 'PANEL_REPORT' ELSE 'D_FILE' END AS doc_class,
    CASE WHEN n % 2 = 0 THEN 'Add' END AS variant, concat('d', n) AS date, CASE WHEN turn > 0 THEN turn END AS part_number, 1 + turn % 5 AS page_count, v, n
    FROM (SELECT conv_id, CAST(turn AS INT) AS turn, CAST(floor(conv_id / 10) AS INT) AS case_number, CAST(conv_id % 5 AS INT) AS v, CAST(floor(conv_id / 5) % 2 AS INT) + 1 AS n FROM {turns})"""
_TURNS = "(SELECT DISTINCT conv_id, turn FROM conversations)"
_ORIGINALS = f"""originals AS (SELECT case_number, CASE v WHEN 0 THEN CAST(regexp_extract(original_filename, '-([0-9]+)', 1) AS INT) END AS doc_number, doc_class, variant, CASE WHEN v IN (1, 2) THEN n END AS variant_number,
    first(doc_type ORDER BY part_number NULLS FIRST, original_filename) AS doc_type, first(date ORDER BY part_number NULLS FIRST, original_filename) AS date, CAST(COUNT(*) AS INT) AS num_parts, COUNT(*) > 1 AS is_multi_part,
    string_agg(original_filename, ', ' ORDER BY part_number NULLS FIRST, original_filename) AS part_filenames, first(new_filename ORDER BY part_number NULLS FIRST, original_filename) AS new_filename_base, CAST(SUM(page_count) AS BIGINT) AS page_count_total
    FROM ({FILES.format(turns=_TURNS)}) GROUP BY ALL)"""


def _files(s, d):
    return s.sql(FILES, turns=table(s, d, "conversations").select("conv_id", "turn").distinct())


@query(f", {_ORIGINALS} SELECT * FROM originals")
def doc20_original_documents(s, d):
    """Original documents of files in parts."""
    return documents.original_documents(_files(s, d))


@query(
    f", {_ORIGINALS} SELECT doc_type, CASE WHEN GROUPING(doc_type) = 1 THEN 'all' ELSE 'type' END AS kind, CAST(SUM(num_parts) AS BIGINT) AS total_files, COUNT(*) AS documents, COUNT(*) FILTER (is_multi_part) AS multi_part_documents, CAST(SUM(page_count_total) AS BIGINT) AS total_pages, ROUND(AVG(page_count_total), 6) AS avg_pages, MAX(num_parts) AS max_parts FROM originals GROUP BY GROUPING SETS ((doc_type), ())"
)
def doc20_original_statistics(s, d):
    return documents.original_statistics(documents.original_documents(_files(s, d)))


#: Files with every reason for a review, and with none.
_REVIEWED = {
    "pages": "CASE WHEN doc_id % 11 = 3 THEN 0 WHEN doc_id % 11 <> 4 THEN 2 END",
    "page": "CASE WHEN doc_id % 5 = 0 THEN concat('  ', substr(text, 1, 20), chr(10)) WHEN doc_id % 5 = 1 THEN concat(rpad('x', 60, 'x'), ' ORGANISATION MONDIALE') WHEN doc_id % 5 = 2 THEN concat(rpad('x', 60, 'x'), ' ORGANIZACIÓN MUNDIAL ') WHEN doc_id % 5 = 3 THEN concat(rpad('x', 60, 'x'), text) END",
    "kind": "CASE WHEN doc_id % 3 = 0 THEN 'Addendum' WHEN doc_id % 3 = 1 THEN 'UNKNOWN' END",
    "error": "CASE WHEN doc_id % 13 = 5 THEN 'no file' END",
}


@query(
    f"""SELECT doc_id, CASE WHEN error IS NOT NULL THEN 'processing_error' WHEN COALESCE(pages, 0) = 0 THEN 'empty_pdf' WHEN kind = 'Addendum' THEN NULL WHEN doc_id % 5 IN (0, 4) THEN 'scanned_pdf' WHEN doc_id % 5 IN (1, 2) THEN 'non_english' ELSE 'unknown_doc_type' END AS reason
       FROM (SELECT doc_id, {", ".join(f"{x} AS {c}" for c, x in _REVIEWED.items())} FROM documents)"""
)
def doc17_review_entry(s, d):
    rows = table(s, d, "documents").select("doc_id", *(F.expr(x).alias(c) for c, x in _REVIEWED.items()))
    return rows.select("doc_id", cleaning.review_entry(F.col("pages"), F.col("page"), F.col("kind"), F.col("error")).alias("reason"))


@query()
def doc24_routed_chunks(s, d):
    """Short documents whole, long ones in children of their parents."""
    return documents.routed_chunks(table(s, d, "documents"))
