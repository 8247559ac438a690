"""Pages that are cut off, badly nested or empty, and the names of key facts."""

from pyspark.sql import functions as F

from concordat.operators import pages

HTML = """<div><h2 id=summary>S</h2><p class="paranormaltext">a<br>b<p>c</p><ul><li>x<li>y</ul></section><h3>T &amp; U</h3><p class="odd">stop</p><p>never</p></div>
<table id="keyFactsTbl"><tr><td>In-force date:</td><td>1<td></tr><tr><td>Panel: (circulated)</td><td> 2  3 </td></tr></table><a class="clean-link">DS7 Land"""


def test_trees_and_text():
    root = pages.Tree(HTML).root
    assert [n.tag for n in root.walk()][:4] == ["div", "h2", "p", "br"]
    got = pages._pieces(HTML)
    assert got["facts"] == [{"key": "Panel: (circulated)", "value": "2 3"}] and got["status"] is None and got["number"] is None
    assert [x["text"] for x in got["links"]] == ["DS7 Land"]
    assert pages._pieces(None) == {"links": [], "status": None, "facts": [], "number": None, "summary": None} == pages._pieces("</p>< x")
    plain = pages._pieces('<h2 id="summary">S</h2>loose<p>one</p><h3> T &amp; <b>U</b></h3><ul><li>x</li></ul><p class="odd">stop</p><p>no</p>')
    assert plain["summary"] == [{"kind": "p", "text": "one"}, {"kind": "h3", "text": "T &U"}, {"kind": "li", "text": "x"}]


def test_records_of_empty_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>"), (4, '<h2 id="summary">x</h2>')], "page_id int, html string")
    found = {r.page_id: r for r in pages.case_records(rows).collect()}
    assert all(found[k].facts == {} and found[k].current_status is None for k in found)
    assert found[4].summary == "" and found[1].summary is None
    assert pages.case_titles(rows).count() == 0


def test_fact_keys(spark):
    labels = {
        "Agreements cited\n(as cited in request for consultations):": "agreements_cited_consultations",
        "Agreements cited": "agreements_cited",
        "Third Parties (Art 21.5 compliance)": "third_parties_compliance",
        "Third Parties (original proceedings)": "third_parties",
        "Art 21.3(c) award:": "Art 21.3(c) award",
        "In-force date::": "inforce_date",
        "Panel: (circulated)": "panel",
    }
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    assert {r.label: r.key for r in rows.select("label", pages.fact_key(F.col("label")).alias("key")).collect()} == labels
