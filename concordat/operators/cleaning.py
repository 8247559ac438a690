"""Clean-up and typing of case documents, as column expressions over the lines of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.documents import english_lines, small_batches
from concordat.operators.labels import without_footnotes, without_header

#: What marks a line as a page number, as a heading that every page repeats, and as noise.
PAGE_LINE = r"^\s*(?i:page\s+[A-Z]?-?\d+)\s*$|^\s*-\s*\d+\s*-\s*$"
HEADING_LINE = r"^\s*RESTRICTED\s*$|^[ \t]*(?:(?:WORLD\s+TRADE|ORGANIZATION|DISPUTE\s+SETTLEMENT\s+BODY)[ \t*]*)+$|^\s*WT/DS\d+(?:/[A-Za-z0-9/.\-]*)?\s*$|^\s*G/[A-Z]+/[A-Za-z0-9/.\-]+\s*$|^\s*S/L/\d+\s*$"
LANGUAGE_LINE = r"^\s*\(?\s*(?i:anglais|ingles|inglés)\s*/?\s*\)?\s*$|^\s*/\s*$"
NOISE_LINE = r"^[.,:;/\\|*#@!?(){}\[\]\s]+$"
#: A date after the heading's last word, that word before a title, and lists of codes in brackets.
DATED_LINE = r"^[ \t]*ORGANIZATION\s+\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\s*$"
BEFORE_TITLE = r"(?m)^([ \t]*)ORGANIZATION\s+([A-Z][A-Z\s\-–])"
BRACKETED_LINE = r"^\s*\[(?:\s*WT/[\w/]+[,\s]*(?:and\s+)?)+\]\s*$"
#: Codes in the header of a document, in the order of extraction.
HEADER_CODES = (r"WT/DS\d+/[A-Za-z0-9/.\-]+", r"G/[A-Z]+/[A-Za-z0-9/.\-]+", r"S/L/\d+", r"IP/D/\d+")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def blanked(text: Column, pattern: str) -> Column:
    """The text with lines that match the pattern left empty."""
    return F.array_join(F.transform(lines(text), lambda x: F.when(x.rlike(pattern), F.lit("")).otherwise(x)), "\n")


def even_white_space(text: Column) -> Column:
    """At most one empty line, one blank between words, none at the end of a line or around the text."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" +\n", "\n"), r"^\s+|\s+$", "")


def cleaned(text: Column) -> Column:
    """Headings, language markers and page numbers, then noise, then white space."""
    for pattern in (HEADING_LINE, LANGUAGE_LINE, PAGE_LINE, NOISE_LINE):
        text = blanked(text, pattern)
    return even_white_space(text)


def clean_steps(df: DataFrame, text: str, title: str | None = None) -> DataFrame:
    """df with its text cleaned whole, ready to be cut and counted: the header, headings and lists of codes of every page,
    language markers, page numbers, footnotes, lines in other languages, titles after the first, noise and white space.

    Each step is a column of its own that reads the one before, as Spark would otherwise write out the whole of a text's
    making wherever the next step names it. A null text is empty; a null or short title is not looked for.
    """
    steps = [
        lambda x: without_header(F.coalesce(x, F.lit(""))),
        lambda x: F.regexp_replace(blanked(blanked(x, HEADING_LINE), DATED_LINE), BEFORE_TITLE, "$1$2"),
        lambda x: blanked(blanked(blanked(x, BRACKETED_LINE), LANGUAGE_LINE), PAGE_LINE),
        without_footnotes,
        english_lines,
        *([lambda x: F.coalesce(title_once(x, F.col(title)), x)] if title else []),
        lambda x: even_white_space(blanked(x, NOISE_LINE)),
    ]
    df = small_batches(df)
    for step in steps:
        df = df.withColumn(text, step(F.col(text)))
    return df


def header_codes(text: Column, first: int = 800) -> Column:
    """All codes in the header, by kind and then by place."""
    head = F.substring(text, 1, first)
    return F.concat(*(F.regexp_extract_all(head, F.lit(p), F.lit(0)) for p in HEADER_CODES))


def is_contents_page(text: Column, share: float = 0.3, least: int = 50) -> Column:
    """A roman page number in the head, the label, or dots that lead to numbers in more than such a share of lines."""
    filled = F.filter(lines(text), lambda x: F.trim(x) != "")
    dotted = F.filter(filled, lambda x: x.rlike(r"\.{10,}"))
    roman = F.substring(text, 1, 300).rlike(r"(?im)page\s+[ivxlc]+\s*$")
    return (F.length(F.trim(text)) >= least) & (roman | text.rlike(r"(?i)TABLE\s+OF\s+CONTENTS") | (F.size(dotted) > share * F.size(filled)))


def title_once(text: Column, title: Column, least: int = 10) -> Column:
    """The text with every later occurrence of its title removed, in any case and with any white space between words."""
    at = F.instr(text, title)
    rest = F.substring(text, at + F.length(title), F.length(text))
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.replace(title, F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
    once = F.concat(F.substring(text, F.lit(1), at + F.length(title) - 1), F.regexp_replace(rest, pattern, F.lit("")))
    return F.when((F.length(title) >= least) & (at > 0), once).otherwise(text)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Words times 1.3, cut to an integer."""
    return F.floor(F.size(words(text)) * 1.3)


def review_reason(text: Column, foreign_share: Column, least: int = 50) -> Column:
    """Why somebody has to look at a document, null if nobody has to."""
    known = F.trim(F.coalesce(text, F.lit("")))
    return F.when(known == "", "empty").when(F.length(known) < least, "scanned").when(foreign_share >= 0.2, "non_english")


#: Names in the head of a first page in French and in Spanish.
OTHER_HEADINGS = ("ORGANISATION MONDIALE", "ORGANIZACIÓN MUNDIAL")


def review_entry(pages: Column, first_page: Column, doc_type: Column, error: Column, least: int = 50) -> Column:
    """Why somebody has to look at a file, null if nobody has to: it could not be worked on (error tells why), it has no
    pages, or no type was found, and then its first page is nearly empty, in another language, or neither."""
    page = F.coalesce(first_page, F.lit(""))
    other = F.contains(page, F.lit(OTHER_HEADINGS[0])) | F.contains(page, F.lit(OTHER_HEADINGS[1]))
    untyped = F.when(F.length(F.regexp_replace(page, r"^\s+|\s+$", "")) < least, "scanned_pdf").when(other, "non_english").otherwise("unknown_doc_type")
    return F.when(error.isNotNull(), "processing_error").when(F.coalesce(pages, F.lit(0)) == 0, "empty_pdf").when(F.coalesce(doc_type, F.lit("UNKNOWN")) == "UNKNOWN", untyped)
