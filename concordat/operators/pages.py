"""Records from the HTML of case pages: titles of a list, and status, key facts, number and summary of a case.

A page is read by the standard tokenizer into a small tree, once a row; it hands on plain pieces of text. Spacing, keys
and the choice among pieces are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as t
from concordat.operators.documents import small_batches

#: Elements that have no content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not text of the page.
HIDDEN = ("script", "style", "template")


class Node:
    """An element with its attributes and its children, elements and strings."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, Node):
                if child.tag not in HIDDEN:
                    yield from child.strings()
            elif child.strip():
                yield child.strip()

    def text(self, separator: str = "") -> str:
        """The strings put together; with a separator white space of any kind becomes one blank."""
        found = separator.join(self.strings())
        return " ".join(found.split()) if separator else found

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Tree(HTMLParser):
    """The tree of a page; an end tag closes up to the last element of its name, one that was not opened is passed over."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _following(root: Node, start: Node, tag: str, name: str) -> Node | None:
    """The first element of this tag and class after start, in the order of the page."""
    passed = False
    for node in root.walk():
        if passed and node.tag == tag and name in node.classes():
            return node
        passed = passed or node is start
    return None


def _summary(heading: Node) -> list[tuple[str, str]]:
    """(kind, text) of the elements after a heading up to the next one of its rank, or to a paragraph of another class."""
    out: list[tuple[str, str]] = []
    after = heading.parent.children[heading.parent.children.index(heading) + 1 :]
    for node in (x for x in after if isinstance(x, Node)):
        if node.tag == "h2":
            break
        if node.tag == "h3":
            out.append(("h3", node.text()))
        elif node.tag == "p":
            named = "paranormaltext" in node.classes()
            if node.classes() and not named:
                break
            if named or node.text():
                out.append(("p", node.text(" ")))
        elif node.tag == "ul":
            out += [("li", x.text(" ")) for x in node.walk() if x.tag == "li"]
    return out


def _pieces(html: str | None) -> dict:
    root = Tree(html or "").root
    first = lambda tag, key, value: next((x for x in root.walk() if x.tag == tag and value in (x.classes() if key == "class" else [x.attrs.get(key)])), None)
    status, table, number, summary = first("h2", "id", "status"), first("table", "id", "keyFactsTbl"), first("span", "class", "dsnumber"), first("h2", "id", "summary")
    well = _following(root, status, "div", "well") if status else None
    rows = [[c for c in r.walk() if c.tag == "td"] for r in table.walk() if r.tag == "tr"] if table else []
    return {
        "links": [{"class": a.attrs.get("class", ""), "href": a.attrs.get("href", ""), "text": a.text()} for a in root.walk() if a.tag == "a"],
        "status": well.text(" ") if well else None,
        "facts": [{"key": c[0].text(), "value": c[1].text(" ")} for c in rows if len(c) == 2],
        "number": number.text() if number else None,
        "summary": [{"kind": k, "text": x} for k, x in _summary(summary)] if summary else None,
    }


KIND = "links array<struct<class: string, href: string, text: string>>, status string, facts array<struct<key: string, value: string>>, number string, summary array<struct<kind: string, text: string>>"


def pieces(html: Column) -> Column:
    @F.pandas_udf(KIND)
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pieces(x) for x in pages], columns=["links", "status", "facts", "number", "summary"])

    return read(html)


def case_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """case_no and title of the cases that pages list, the last of equal numbers on a page: links of the class clean-link
    whose text is DS, a number and a title; where a page has none, links to a case's page with such a text."""
    found = small_batches(pages).select(*(c for c in pages.columns if c != html), pieces(F.col(html))["links"].alias("_links"))
    named = lambda x: x["text"].rlike(r"^DS(\d+)\s*(.+)$")
    clean = F.filter("_links", lambda x: F.array_contains(F.split(x["class"], r"\s+"), F.lit("clean-link")) & named(x))
    linked = F.filter("_links", lambda x: x["href"].rlike(r"/cases_e/ds(\d+)_e\.htm") & named(x))
    chosen = found.withColumn("_links", F.when(F.size(clean) > 0, clean).otherwise(F.transform(linked, lambda x: x)))
    rows = chosen.select(*(c for c in found.columns if c != "_links"), F.posexplode("_links").alias("_at", "_link"))
    number = F.coalesce(F.nullif(F.regexp_extract("_link.href", r"/cases_e/ds(\d+)_e\.htm", 1), F.lit("")), F.regexp_extract("_link.text", r"^DS(\d+)", 1))
    of_text = F.regexp_extract("_link.text", r"^DS(\d+)\s*(.+)$", 1)
    case_no = F.when(F.array_contains(F.split("_link.class", r"\s+"), F.lit("clean-link")), of_text).otherwise(number).cast("int")
    keys = [c for c in found.columns if c != "_links"]
    rows = rows.select(*keys, "_at", case_no.alias("case_no"), F.trim(F.regexp_extract("_link.text", r"^DS(\d+)\s*(.+)$", 2)).alias("title"))
    return rows.groupBy(*keys, "case_no").agg(F.max_by("title", "_at").alias("title"))


def fact_key(label: Column) -> Column:
    """The name of a key fact: one name for labels that differ by what stands in brackets, labels of articles as they are."""
    label = F.regexp_replace(label, r":+$", "")
    low = F.lower(label)
    has = lambda words: F.contains(low, F.lit(words))
    base = F.regexp_replace(F.trim(F.when(F.contains(label, F.lit("(")), F.substring_index(label, "(", 1)).otherwise(label)), r":+$", "")
    return (
        F.when(F.contains(label, F.lit("Agreements cited")), F.when(has("panel request"), "agreements_cited_panel").when(has("request for consultations"), "agreements_cited_consultations").otherwise("agreements_cited"))
        .when(F.contains(label, F.lit("Third Part")), F.when(~has("original") & (has("art 21.5") | has("compliance")), "third_parties_compliance").otherwise("third_parties"))
        .when(F.startswith(label, F.lit("Art ")), label)
        .otherwise(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(F.trim(base), r"[^a-zA-Z0-9\s]", ""), r"\s+", "_")), r"^_+|_+$", ""))
    )


def case_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with current_status, case_number_raw, summary and facts (a map by normal key, the last of equal keys) in
    place of html; null, or an empty map, where the page has none of it."""
    keep = [c for c in pages.columns if c != html]
    rows = small_batches(pages).select(*keep, pieces(F.col(html)).alias("_p"))
    facts = F.transform("_p.facts", lambda x: F.struct(fact_key(x["key"]).alias("key"), t.spaced(x["value"]).alias("value")))
    facts = F.filter(facts, lambda x: F.coalesce(x["key"], F.lit("")) != "")
    last = F.filter(facts, lambda x, i: F.size(F.filter(facts, lambda y, j: (y["key"] == x["key"]) & (j > i))) == 0)
    line = lambda x: F.when(x["kind"] == "h3", F.concat(F.lit("\n"), x["text"], F.lit("\n"))).when(x["kind"] == "li", F.concat(F.lit("- "), t.spaced(x["text"]))).otherwise(t.spaced(x["text"]))
    summary = F.regexp_replace(F.array_join(F.transform("_p.summary", line), "\n"), r"^\s+|\s+$", "")
    return rows.select(*keep, t.spaced(F.col("_p.status")).alias("current_status"), F.col("_p.number").alias("case_number_raw"), F.map_from_entries(last).alias("facts"), summary.alias("summary"))
