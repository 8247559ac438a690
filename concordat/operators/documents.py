"""Text rules for case documents: file names, dates, codes, clean-up, sequences, chunks and sections."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that mark French and Spanish lines.
FRENCH_WORDS = (
    "le", "la", "les", "des", "du", "une", "un", "qui", "que",
    "dans", "par", "pour", "avec", "sur", "sont", "cette",
    "ces", "aux", "ont", "nous", "leur", "pas", "mais", "aussi",
    "peut", "soit", "tous", "tout", "ses", "elle",
)
SPANISH_WORDS = (
    "el", "los", "las", "del", "una", "un", "que", "por", "para",
    "con", "como", "esta", "este", "sus", "pero", "sin",
    "entre", "sobre", "desde", "hasta", "todos", "puede", "cada",
)
FOREIGN_WORDS = tuple(dict.fromkeys(FRENCH_WORDS + SPANISH_WORDS))
#: A run of letters, digits and underscores, and the runs that are words here.
RUN, WORD = r"[\p{L}\p{N}_]+", "^[a-zà-ÿ]+$"
#: Month names in English, French and Spanish.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}


def english_lines(text: str | Column = "text", share: float = 0.2, least: int = 5) -> Column:
    """The text without lines of at least so many words of which at least such a share is French or Spanish."""
    marks = F.array(*(F.lit(w) for w in FOREIGN_WORDS))

    cut = F.transform(F.split(F.col(text) if isinstance(text, str) else text, "\n"), lambda x: F.struct(x.alias("line"), F.filter(F.regexp_extract_all(F.lower(x), F.lit(RUN), F.lit(0)), lambda w: w.rlike(WORD)).alias("words")))
    marked = F.transform(cut, lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"), F.size(F.filter(x["words"], lambda w: F.array_contains(marks, w))).alias("foreign")))
    kept = F.filter(marked, lambda x: (x["n"] < least) | (x["foreign"] < share * x["n"]))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def file_parts(name: str) -> Column:
    """case, kind, number, variant and part of a document's file name such as 135-2A1.pdf, 135ABR.pdf or D15.pdf."""
    stem = F.regexp_replace(F.upper(F.col(name)), r"\.PDF$", "")
    get = lambda pattern, i: F.nullif(F.regexp_extract(stem, pattern, i), F.lit(""))
    numbered, report = r"^(\d+)-(\d+)(?:([A-Z])(\d+))?$", r"^(\d+)(ABR|ARB|R)(?:(W)(\d*))?(?:(A)(\d+))?(?:-(\d+))?$"
    kind = (
        F.when(stem.rlike(r"^D\d+$"), "decision")
        .when(stem.rlike(numbered), "numbered")
        .when(stem.rlike(r"^\d+ABR"), "appeal_report")
        .when(stem.rlike(r"^\d+ARB"), "arbitration")
        .when(stem.rlike(r"^\d+RW"), "compliance_report")
        .when(stem.rlike(report), "report")
        .otherwise("other")
    )
    return F.struct(
        F.coalesce(get(r"^(\d+)", 1), get(r"^D(\d+)$", 1)).try_cast("int").alias("case_no"),
        kind.alias("kind"),
        get(numbered, 2).try_cast("int").alias("number"),
        F.coalesce(get(numbered, 3), get(report, 5)).alias("variant"),
        F.coalesce(get(numbered, 4), get(report, 7), get(report, 6)).try_cast("int").alias("part"),
    )


def text_date(text: str) -> Column:
    """The first date such as '7 November 1996' or '7 de noviembre de 1996' in three languages."""
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    pattern = rf"(?i)\b(\d{{1,2}})(?:er)?\s+(?:de\s+)?({names})\s+(?:de\s+)?(\d{{4}})\b"
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    get = lambda i: F.nullif(F.regexp_extract(F.col(text), pattern, i), F.lit(""))
    return F.try_make_date(get(3).try_cast("int"), F.try_element_at(months, F.lower(get(2))), get(1).try_cast("int")) if hasattr(F, "try_make_date") else F.try_to_date(F.format_string("%s-%s-%s", get(3), F.try_element_at(months, F.lower(get(2))).cast("string"), get(1)), "y-M-d")


def parties(text: str) -> Column:
    """Names of a list packed with ';' or written as a Python literal; trimmed, without empty ones."""
    literal = F.col(text).rlike(r"^\s*\[.*\]\s*$")
    quoted = F.regexp_extract_all(F.col(text), F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    items = F.when(literal, F.transform(quoted, lambda x: F.substring(x, 2, 10000))).otherwise(F.split(F.col(text), ";"))
    return F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, "['\"]$", ""))), lambda x: x != "")


def section_of_code(code: str) -> Column:
    """Section number 1 to 21 of a commodity code such as 7208, 72.08 or HS 87; NULL if there is none."""
    chapter = F.regexp_extract(F.regexp_replace(F.col(code), r"[^0-9]", ""), r"^(\d{2})", 1).try_cast("int")
    #: The last chapter of each section.
    ends = (5, 14, 15, 24, 27, 38, 40, 43, 46, 49, 63, 67, 70, 71, 83, 85, 89, 92, 93, 96, 97)
    out = F.lit(None).cast("int")
    for k in range(len(ends), 0, -1):
        out = F.when((chapter >= 1) & (chapter <= ends[k - 1]), k).otherwise(out)
    return out


def sequence_numbers(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def inherited_first(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Values of a group's first row where a later row has none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(c, F.first(c).over(w)) for c in columns})


def _split(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[tuple[int, int]]:
    """(start, end) of parts no longer than size: cut at the first separator that occurs, then at the next inside
    parts that are still too long."""

    def cut(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
            return
        sep = separators[level]
        if not sep:
            yield from ((i, min(i + size, b)) for i in range(a, b, size))
            return
        at = a
        while at < b:
            end = text.find(sep, at, b)
            end = b if end < 0 else end + len(sep)
            yield from cut(at, end, level + 1)
            at = end

    return list(cut(0, len(text), 0)) if text else []


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most size characters that cover text; each begins up to overlap characters before the last's end."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for part in _split(text, size):
        if held and part[1] - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or part[1] - held[0][0] > size):
                held.pop(0)
        held.append(part)
    return [*out, (held[0][0], held[-1][1])] if held else out


def small_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """df; the session's Arrow batches have so many rows at most from now on, so that long texts do not add up in the
    memory of Python workers, whatever the size of a task."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    return df


def chunks(docs: DataFrame, parent: tuple[int, int] = (6000, 800), child: tuple[int, int] = (1200, 200)) -> DataFrame:
    """Child chunks of documents with the parent each begins in: doc_id, parent_no, child_no, start, end, chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                spans = chunk_spans(text or "", *parent)
                ends = [end for _, end in spans]
                for k, (a, b) in enumerate(chunk_spans(text or "", *child)):
                    p = bisect.bisect_right(ends, a)  # the first parent that ends after the child's begin
                    rows.append((doc_id, p if p < len(spans) and spans[p][0] <= a else len(spans) - 1, k, a, b, text[a:b]))
            yield pd.DataFrame(rows, columns=["doc_id", "parent_no", "child_no", "start", "end", "chunk"])

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, parent_no int, child_no int, start int, end int, chunk string")


def routed_chunks(docs: DataFrame, longest: int = 6000) -> DataFrame:
    """doc_id, chunk_id, parent_id, is_chunked, chunk_index, n_tokens and chunk: a document of at most longest tokens (words
    times 1.3) is one chunk and its own parent, a longer one is cut into children of its parents. Null, empty and blank
    texts have no chunks."""
    tokens = lambda c: F.floor(F.size(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")) * 1.3)
    rows = docs.select("doc_id", "text").filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("n_tokens", tokens("text"))
    name = F.col("doc_id").cast("string")
    whole = F.concat(name, F.lit("_full"))
    short = rows.filter(F.col("n_tokens") <= longest).select("doc_id", whole.alias("chunk_id"), whole.alias("parent_id"), F.lit(False).alias("is_chunked"), F.lit(0).alias("chunk_index"), "n_tokens", F.col("text").alias("chunk"))
    cut = chunks(rows.filter(F.col("n_tokens") > longest)).withColumn("n_tokens", tokens("chunk"))
    numbered = lambda kind, n: F.concat(F.col("doc_id").cast("string"), F.lit(f"_{kind}_"), F.lpad(F.col(n).cast("string"), 3, "0"))
    return short.unionByName(cut.select("doc_id", numbered("child", "child_no").alias("chunk_id"), numbered("parent", "parent_no").alias("parent_id"), F.lit(True).alias("is_chunked"), F.col("child_no").alias("chunk_index"), "n_tokens", "chunk"))


def problems(cases: DataFrame) -> DataFrame:
    """case_id and problem, a row for each of the five classes of missing or contradictory data that a case has."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "nan")
    filled = lambda c: ~F.trim(F.coalesce(F.col(c), F.lit(""))).isin("", "nan")
    rules = {
        "empty_product_descriptions": empty("products"),
        "empty_hs_sections": empty("sections"),
        "empty_title_hs": empty("title_sections"),
        "mutual_exclusivity_violation": filled("products") == filled("policy"),
        "failed_severity": F.col("severity").isNull(),
    }
    found = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return cases.select("case_id", F.explode(found).alias("problem"))


#: Classes whose file names have a number after the report's letters, and those letters in the order of trial.
NUMBERED_REPORTS = ("PANEL_REPORT", "AB_REPORT", "RECOURSE", "ARBITRATION")
REPORT_LETTERS = ("RW", "RA", "ABRA", "ABRW", "ARB", "R")


def original_key(name: Column, case: Column, doc_class: Column, variant: Column) -> Column:
    """What files of one original document share: case, number in the file name, class, variant and number of the report."""
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("int")
    after_case = F.when(F.startswith(name, F.concat(case.cast("string"), F.lit("-"))), F.regexp_extract(F.substring(name, F.length(case.cast("string")) + 2, F.length(name)), r"^(\d+)", 1).try_cast("int"))
    report = F.when(doc_class.isin(*NUMBERED_REPORTS), F.coalesce(*(number(letters + r"(\d+)") for letters in REPORT_LETTERS)))
    return F.struct(case.alias("case_number"), after_case.alias("doc_number"), doc_class.alias("doc_class"), variant.alias("variant"), report.alias("variant_number"))


def original_documents(files: DataFrame) -> DataFrame:
    """A row for each original document: its key, the type, date and new name of its first part, its parts and pages.

    files has case_number, original_filename, new_filename, doc_type, doc_class, variant, date, part_number and
    page_count. Parts are in the order of their numbers, one without a number first, then of their names. What is
    gathered are the few files of a document.
    """
    key = original_key(F.col("original_filename"), F.col("case_number"), F.col("doc_class"), F.col("variant"))
    part = F.struct(F.col("part_number").isNotNull().alias("numbered"), "part_number", "original_filename", "new_filename", "doc_type", "date", "page_count")
    grouped = files.select(key.alias("key"), part.alias("part")).groupBy("key").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    first = F.col("parts")[0]
    return grouped.select(
        "key.*",
        first["doc_type"].alias("doc_type"),
        first["date"].alias("date"),
        F.size("parts").alias("num_parts"),
        (F.size("parts") > 1).alias("is_multi_part"),
        F.array_join(F.transform("parts", lambda p: p["original_filename"]), ", ").alias("part_filenames"),
        first["new_filename"].alias("new_filename_base"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p["page_count"], F.lit(0))).alias("page_count_total"),
    )


def original_statistics(originals: DataFrame) -> DataFrame:
    """Figures of original documents by type and over all (doc_type null, kind all)."""
    figures = [
        F.sum("num_parts").alias("total_files"),
        F.count(F.lit(1)).alias("documents"),
        F.count_if("is_multi_part").alias("multi_part_documents"),
        F.sum("page_count_total").alias("total_pages"),
        F.round(F.avg("page_count_total"), 6).alias("avg_pages"),
        F.max("num_parts").alias("max_parts"),
    ]
    return originals.groupingSets([["doc_type"], []], "doc_type").agg(F.when(F.grouping("doc_type") == 1, "all").otherwise("type").alias("kind"), *figures)
