"""Tables with spans, by plain examples."""

from lectern.sources import grids


def grid(spark, html):
    rows = grids.html_tables(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html").collect()
    tables = {}
    for r in sorted(rows, key=lambda r: (r.table_no, r.row_no, r.col_no)):
        tables.setdefault(r.table_no, {}).setdefault(r.row_no, []).append(r.text)
    return [[rows[n] for n in sorted(rows)] for _, rows in sorted(tables.items())]


def test_spans(spark):
    html = """<table><thead><tr><th rowspan=2>a</th><th colspan="2">b <i>c</i></th></tr><tr><th>d</th><th>e</th></tr></thead>
    <tr><td>1</td><td rowspan='3'>2</td><td>3<script>x</script></td></tr><tr><td>4<td>5</tr><tr></tr></table>"""
    assert grid(spark, html) == [[["a", "b c", ""], ["a", "d", "e"], ["1", "2", "3"], ["4", "2", "5"], ["2"]]]
    assert grid(spark, "<table><td rowspan=2 colspan=2>x</td><td>y</td><tr><td>z</table>") == [[["x", "", "y"], ["x", "", "z"]]]
    assert grid(spark, "<table><tr><td colspan=odd rowspan=-3>x</td><td colspan=0>y</table>") == [[["x", "y"]]]
    assert [len(r) for r in grid(spark, "<table><tr><td colspan=9999>x</table>")[0]] == [grids.MOST_COLUMNS]


def test_tables_within_tables_and_none(spark):
    inner = "<table><tr><td>p<table><tr><td>q</td></tr></table>r</td><td>s</td></tr></table>"
    assert grid(spark, inner) == [[["p q r", "s"]], [["q"]]]
    assert grid(spark, "</table><td>x</td><table></table>") == grid(spark, "") == grid(spark, None) == []


def test_markdown(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a|b<th>c<tr><td>d</table>"), (2, "<table><tr><td>x</table>")], "k int, html string")
    found = {r.k: r.markdown for r in grids.as_markdown(grids.html_tables(pages, "k", "html"), "k").collect()}
    assert found == {1: "| a\\|b | c |\n| --- | --- |\n| d |", 2: "| x |\n| --- |"}
