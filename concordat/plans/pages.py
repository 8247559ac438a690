"""Case pages to records; pages are the given ones inside a frame, so that the SQL knows what a reader must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import pages
from concordat.plans.catalog import query
from concordat.sources.views import table

#: A page with a status, key facts and a summary, some left out, around the given page.
FRAMED = """concat('<html><body><h1>x</h1><span class="big dsnumber"> DS', page_id, ' </span>', CASE WHEN page_id % 5 = 4 THEN '' ELSE concat('<h2 id="status">Status</h2><div class="other">no</div><div class="note well">In <b>consultations</b> on26&nbsp;July&#32;', page_id, '</div>') END,
    CASE WHEN page_id % 7 = 6 THEN '' ELSE concat('<table id="keyFactsTbl"><tr><th>a</th><th>b</th></tr><tr><td>Short title:</td><td>Goods <i>of</i> ', page_id, '</td></tr><tr><td>only one</td></tr><tr><td>Agreements cited (as cited in panel request):</td><td>Art.XI of&amp;with</td></tr>',
      '<tr><td>Third Parties (original proceedings):</td><td></td></tr><tr><td>Art 21.5 report:</td><td>a<br>b</td></tr><tr><td>Complainant (by):</td><td>First</td></tr><tr><td>Complainant:</td><td>Second<script>no()</script></td></tr></table>') END,
    CASE WHEN page_id % 3 = 2 THEN '' ELSE concat('<div><h2 id="summary">Summary</h2><h3>Consultations</h3><p class="paranormaltext">On <b>1</b> May</p><p></p><p>plain', page_id, '</p><ul><li>one <i>item</i></li><li>two</li></ul>', CASE WHEN page_id % 2 = 0 THEN '<p class="other">not</p><p>nor this</p>' ELSE '' END, '<h2>Next</h2><p>no</p></div>') END, html)"""


@query(
    """SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN concat('In consultations on 26 July ', page_id) END AS current_status, concat('DS', page_id) AS case_number_raw,
       CASE WHEN page_id % 7 <> 6 THEN concat('Goods of ', page_id) END AS short_title, CASE WHEN page_id % 7 <> 6 THEN 'Art. XI of&with' END AS agreements, CASE WHEN page_id % 7 <> 6 THEN '' END AS thirds, CASE WHEN page_id % 7 <> 6 THEN 'a b' END AS report,
       CASE WHEN page_id % 7 <> 6 THEN 'Second' END AS complainant, CASE WHEN page_id % 7 <> 6 THEN 5 ELSE 0 END AS n_facts,
       CASE WHEN page_id % 3 <> 2 THEN concat('Consultations', chr(10), chr(10), 'On 1 May', chr(10), 'plain ', page_id, chr(10), '- one item', chr(10), '- two') END AS summary FROM pages"""
)
def src10_case_records(s, d):
    rows = pages.case_records(table(s, d, "pages").select("page_id", F.expr(FRAMED).alias("html")))
    fact = lambda key: F.try_element_at("facts", F.lit(key))
    return rows.select(
        "page_id", "current_status", "case_number_raw", fact("short_title").alias("short_title"), fact("agreements_cited_panel").alias("agreements"), fact("third_parties").alias("thirds"),
        fact("Art 21.5 report").alias("report"), fact("complainant").alias("complainant"), F.size("facts").alias("n_facts"), "summary",
    )


#: Lists of cases: by class on most pages, by address alone on every fourth, one number twice.
LISTED = """concat('<ul>', CASE WHEN page_id % 4 = 3 THEN concat('<a href="/x/cases_e/ds', page_id, '_e.htm">DS', page_id, '<br>Land &mdash; Goods</a><a href="/y">DS1 no</a>')
    ELSE concat('<a class="clean-link b" href="/n">DS', page_id, ' First</a><a class="clean-link">DS', page_id, '<b>Land</b> &#8212; Goods</a><a class="clean-link">no number</a><a class="clean-link">DS', page_id + 1, 'Other</a>') END, '</ul>', html)"""


@query(
    """SELECT page_id, case_no, title FROM (SELECT page_id, page_id AS case_no, CASE WHEN page_id % 4 = 3 THEN 'Land — Goods' ELSE 'Land— Goods' END AS title FROM pages UNION ALL SELECT page_id, page_id + 1, 'Other' FROM pages WHERE page_id % 4 <> 3)"""
)
def src10_case_titles(s, d):
    return pages.case_titles(table(s, d, "pages").select("page_id", F.expr(LISTED).alias("html"))).withColumn("case_no", F.col("case_no").cast("long"))
