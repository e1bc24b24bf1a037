"""Pages by their headings: states that higher headings reset, dates that carry on, odd and empty pages."""

from tallyline.sources import outline

COVERAGE = """<script>var x = "<h3>periods</h3>";</script><table><tr><td>before</td><td>1 of 2</td><td>50</td></tr></table>
<h3>Time periods</h3><tr><td>no gender</td><td>Jan 2001</td><td>Feb 2002</td></tr>
<h4>Women's <i>Matches</i></h4><table><tr><th>Match Type</th><th>a</th><th>b</th></tr><tr><td>Test Matches<td>Jan 2001</td><td>bad</td></tr><tr><td>The &lt;Cup&gt; &#233;&#127951;</td><td> Mar 2003 </td><td></td></tr></table>
<h3>Match numbers</h3><h4>By Competition</h4><tr><td>Both</td><td>1 of 2</td><td>50</td></tr>
<h6>Men</h6><tr><td>Cup</td><td>1,200 of 2,400</td><td>50.0</td></tr><tr><td>Cup</td><td>some</td><td>x</td></tr><tr><td>two</td><td>1 of 1</td></tr>
<h6>Female</h6><tr><td>Cup</td><td>3 of 4</td><td></td></tr>
<h4>By Team</h4><tr><td>Team</td><td>1 of 2</td><td>x</td></tr><tr><td>Oaks</td><td>5 of 5</td><td>100</td></tr><h4>By Competition</h4><tr><td>Elms</td><td>6 of 9</td><td>n/a</td></tr>
<h3>Else</h3><tr><td>Oaks</td><td>5 of 5</td><td>100</td></tr>"""
MISSING = """<h4>By Match Type</h4><h5>Tests Matches</h5><h6>Men's</h6><dl><dt>2001-01-01</dt><dd>A vs B</dd><dd>C vs D vs E</dd><dt>2001-01-02<dd>alone</dl>
<h6>Women's</h6><dl><dd>F vs G</dd></dl><h5>one day cup ( x) Matches</h5><dl><dd>no date vs yet</dd><dt>2001-02-03</dt><dd>H vs I</dd></dl>
<h4>By competition</h4><dl><dd>J vs K</dd></dl><h5>one day cup ( x) matches</h5><dt>2002-01-01</dt><dd>L &amp; M vs N</dd><h4>Other</h4><dd>O vs P</dd>"""


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_coverage_by_hand(spark):
    periods, counts = outline.coverage(pages(spark, COVERAGE))
    assert rows(periods) == sorted([(0, "female", "match type", "Test Matches", "2001-01", None), (0, "female", "competition", "The <Cup> é\U0001f3cf", "2003-03", None)], key=str)
    assert rows(counts) == sorted([(0, "male", "competition", "Cup", 1200, 2400, 50.0), (0, "female", "competition", "Cup", 3, 4, None), (0, None, "team", "Oaks", 5, 5, 100.0), (0, None, "team", "Elms", 6, 9, None)], key=str)


def test_missing_by_hand(spark):
    names = spark.createDataFrame([("One-Day Cup (X)",), (None,)], "name string")
    got = rows(outline.missing(pages(spark, MISSING), {"tests": "Test matches"}, names))
    cup, test = "One-Day Cup (X)", "Test matches"
    assert got == sorted([
        (0, "match type", test, "male", "2001-01-01", "A", "B"), (0, "match type", test, "male", "2001-01-01", "C", "D vs E"), (0, "match type", test, "male", "2001-01-02", "alone", None),
        (0, "match type", test, "female", "2001-01-02", "F", "G"), (0, "match type", "one day cup ( x)", None, "2001-02-03", "H", "I"), (0, "competition", "one day cup ( x)", None, "2001-02-03", "J", "K"),
        (0, "competition", cup, None, "2002-01-01", "L & M", "N"),
    ], key=str)


def test_odd_pages_have_no_rows(spark):
    odd = pages(spark, None, "", "<p>no headings</p>", "<h3></h3>", "<h3>periods<h4>broken")
    for df in (*outline.coverage(odd), outline.missing(odd), *outline.coverage(odd.limit(0))):
        assert df.count() == 0
    verdicts = {tuple(r) for r in outline.page_gate({"a": outline.missing(odd), "b": outline.missing(pages(spark, MISSING)), "c": None}).collect()}
    assert verdicts == {("a", 0, "fail"), ("b", 7, "ok"), ("c", None, "warn")}


def test_long_pages_and_plan(spark, capsys):
    html = "<h4>By match type</h4><h5>Tests matches</h5>" + "".join(f"<dt>{d}</dt><dd>A vs B</dd>" for d in range(20_000))
    found = outline.missing(pages(spark, html))
    assert found.count() == 20_000 and found.select("date").distinct().count() == 20_000
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "EvalPython" not in plan and "MapIn" not in plan
