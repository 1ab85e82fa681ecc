"""Tables: nesting, headers, spans, markup that isn't closed."""

from quillspark.operators import corpus as C


def _texts(html):
    return [[[cell for cell, _ in row] for row in x.grid] for x in C.tables_of(html)]


def test_nested_and_second_tables():
    html = "<table><tr><td>a<table><tr><td>in</td></tr></table>z</td><td>b</td></tr><tr><td>c</td></tr></table> x <TABLE><td>last</TABLE>"
    assert _texts(html) == [[["az", "b"], ["c"]], [["in"]], [["last"]]]
    assert [x.within for x in C.tables_of(html)] == [None, 0, None]
    deep = "<table><td>1" * 40 + "</table>" * 40
    assert [x.within for x in C.tables_of(deep)] == [None, *range(39)] and _texts(deep) == [[["1"]]] * 40


def test_headers():
    html = "<table><tr><th colspan=2>Title</th></tr><tr><th>Name</th><th>Born</th></tr><tr><th>row</th><td>1</td></tr><tr><td>2<td>3</table>"
    table = C.tables_of(html)[0]
    assert table.header_rows() == 2 and table.find_header("Born", "Name") == 1 and table.find_header("row") == 2 and table.find_header("2") is None
    assert table.grid[2] == [("row", True), ("1", False)]
    assert C.tables_of("<table><tr><th>only</table>")[0].header_rows() == 1
    assert C.tables_of("<table></table>")[0].header_rows() == 0


def test_spans_and_open_ends():
    assert _texts('<table><tr><td rowspan=3>a<td>b<tr><td colspan="2">c<tr><td>d</table>') == [[["a", "b"], ["a", "c", "c"], ["a", "d"]]]
    assert _texts("<table><tr><td rowspan=2 colspan='2'>x</td><td>y</td></tr><tr><td>z</td></tr></table>") == [[["x", "x", "y"], ["x", "x", "z"]]]
    assert _texts("<table><tr><td>a<tr><tr><td rowspan=0>b") == [[["a"], ["b"]]]
    assert _texts("<table><td>a</td>between<td>b") == [[["a", "b"]]]
    assert _texts("</table><td>no</td></tr> text <!-- <table><td>x</table>") == []
    assert _texts("<table><caption>t</caption><tr><td><!-- <td>no --> a <b>b</b> &amp; c</td></tr>") == [[["a b &amp; c"]]]
    assert C.table_grid("no table") == [] and C.table_grid("<table><td>1</table><table><td>2</table>") == [["1"]]
