import pytest

from tablewright.sources import extract


def raster(html):
    return extract.rasterize(extract.html_tables(html)[0])[0]


def test_known_rasters():
    assert raster("<table><tr><td rowspan=2>A<td colspan=2>B<tr><td>C<td>D</table>") == [[0, 1, 1], [0, 2, 3]]
    assert raster("<table><tr><td>a<td>b<td>c<tr><td>d<td>e</table>") == [[0, 1, 2], [3, 4, 5]]
    assert raster("<table><tbody><tr><td>b</td></tr></tbody><thead><tr><th rowspan=9>h</th></tr></thead></table>") == [[0], [1]]


@pytest.mark.parametrize("html,code", [
    ("<table><tr><td rowspan=2>A<td>B<td rowspan=2>C<tr><td colspan=2>D</table>", "overlapping"), ("<table></table>", "empty_table"),
    ("<table><tr><td colspan=0>a</table>", "bad_colspan"), ("<table><tr><td rowspan=x>a</table>", "bad_span"), ("<table>" + "<tr><td>a" * 1001 + "</table>", "over_budget"),
])
def test_errors(html, code):
    with pytest.raises(ValueError, match=code):
        raster(html)


def test_nested_and_entities():
    outer, inner = extract.html_tables("<table><tr><td>a &amp; <table><tr><td>b</table> c</table>")
    assert extract.rasterize(outer)[1] == ["a & b c"] and extract.rasterize(inner)[1] == ["b"]


def test_articles(spark):
    xml = '<article xmlns:x="u"><table-wrap><caption><p>Cap</p></caption><table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table></table-wrap></article>'
    df = spark.createDataFrame([("a", xml), ("b", "<article>"), ("c", None), ("d", "<article><table/></article>")], "id string, xml string")
    got = {r["key"]: (r["caption"], r["raster"], r["error"]) for r in extract.extract(df, "id", "xml", "xml").collect()}
    assert got == {"a": ("Cap", [[0], [1]], None), "b": (None, None, "malformed_xml"), "d": ("", None, "empty_table")}


ARTICLE = b"""<?xml version="1.0" encoding="UTF-8"?>
<article><front><article-meta><article-id pub-id-type="PMC">pmc 12</article-id><article-id pub-id-type="pmcid">PMC00012</article-id><article-id pub-id-type="doi">1/2</article-id></article-meta></front>
<body><sec><j:table-wrap id="w1"><label>Table <b>1</b></label><caption><title>Fields</title><p>of<i>oats</i></p></caption><caption><p/></caption>
<alternatives><table id="t1"><tr><td>a &amp; b</td></tr></table></alternatives><table-wrap-foot><fn-group><label>x</label><fn>one</fn><fn-group><fn>two</fn></fn-group></fn-group><p> </p><p>th<b>ree</b></p></table-wrap-foot></j:table-wrap></sec>
<sec><table><caption>Own</caption><tr><td colspan="0">bad</td></tr></table><table-wrap id="w2"><caption/><table><caption>Inner</caption><tbody><tr><td>c<table><tr><td>d</td></tr></table></td></tr></tbody></table></table-wrap></sec></body></article>"""


def test_article_tables_keep_their_context(spark):
    from tablewright.sources import articles

    df = spark.createDataFrame([("a", ARTICLE), ("b", b"<article>"), ("c", None), ("d", b"<article/>")], "id string, xml binary")
    rows = {(r["key"], r["table_index"]): r for r in articles.article_tables(df, "id", "xml").collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", None)} and rows["b", None]["error"] == "malformed_xml"
    one = rows["a", 0]["context"]
    assert (one["source_path"], one["table_id"], one["wrap_path"], one["wrap_id"]) == ("1/2/1/1/4/1", "t1", "1/2/1/1", "w1")
    assert (one["label"], one["caption"], one["caption_external"]) == ("Table 1", "Fields of oats", True)
    assert one["notes"] == ["x", "one", "two", "th ree"] and one["source_table"] == '<table id="t1"><tr><td>a &amp; b</td></tr></table>'
    assert rows["a", 0]["texts"] == ["a & b"]
    two = rows["a", 1]
    assert two["error"] == "bad_colspan" and two["raster"] is None and (two["context"]["caption"], two["context"]["caption_external"], two["context"]["wrap_path"]) == ("Own", False, "")
    three, four = rows["a", 2]["context"], rows["a", 3]["context"]
    assert (three["caption"], three["caption_external"], three["wrap_id"]) == ("Inner", False, "w2") and four["wrap_id"] == "w2" and four["caption"] == ""


def test_article_identities(spark):
    from tablewright.sources import articles

    other = ARTICLE.replace(b"PMC00012", b"PMC13")
    several = b"<pmc-articleset>" + ARTICLE.split(b"?>\n")[1] + b"<article/></pmc-articleset>"
    one = b"<pmc-articleset>" + ARTICLE.split(b"?>\n")[1].replace(b"pmc 12", b"12") + b"</pmc-articleset>"
    df = spark.createDataFrame([("PMC12", ARTICLE.replace(b"pmc 12", b"pmc12"), "ok"), ("PMC12", other, "identity_mismatch"), ("PMC12", several, "nonarticle_root"), ("PMC12", one, "ok"), ("PMC12", b"<x>", "malformed_xml"), ("PMC12", b"<html/>", "nonarticle_root"), ("PMC12", b"<article/>", "identity_mismatch"), ("PMC12", None, "nonarticle_root")], "id string, xml binary, want string")
    for row in df.collect():
        got = articles.identities(articles.article_ids(spark.createDataFrame([row], df.schema), "id", "xml")).first()["identity"]
        assert got == row["want"], row["xml"]


def test_programs_from_files(spark, tmp_path):
    from tablewright.operators import rules
    from tablewright.sources import programs

    def put(name, *lines):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines))
        return str(tmp_path / name)

    put("base.jsonl", '{"type": "Number"}', "", '{"rule": {"regex": "[0-9]+"}, "type": "Number"}', '{"import": "main.jsonl"}')
    put("more/words.jsonl", '{"import": "../base.jsonl"}', '{"rule": {"all": [{"prefix": "a"}, {"not": {"suffix": "z"}}, {"any": [{"equals": "ab"}, {"regex": "a.."}]}]}, "type": "Label"}', '{"guideline": "a name", "type": "Name"}')
    main = put("main.jsonl", '{"rule": {"regex": "[a-z]+"}, "type": "Word"}', '{"type": "Label", "is": ["Short", "Word"]}', '{"subtype": ["Short", "Word"]}', '{"import": "more/words.jsonl"}', '{"import": "base.jsonl"}', '{"option": "enable_caption_analysis"}')
    program = programs.load_program(spark, main)
    assert [(r.type, s) for r, s in zip(program.rules, program.sources)] == [("Number", "base.jsonl:3"), ("Short", "words.jsonl:2"), ("Word", "main.jsonl:1")]
    assert program.guidelines == (("a name", "Name"),) and program.edges == (("Short", "Word"),) and program.options == ("enable_caption_analysis",)
    cells = spark.createDataFrame([("t", i, t) for i, t in enumerate(["12", "ab", "abz", "axy", "q", "?"])], "table_uid string, cell_id int, text string")
    got = {r["text"]: (r["type"], r["source"]) for r in rules.type_cells(program, cells).collect()}
    assert got == {"12": ("Number", "base.jsonl:3"), "ab": ("Short", "words.jsonl:2"), "abz": ("Word", "main.jsonl:1"), "axy": ("Short", "words.jsonl:2"), "q": ("Word", "main.jsonl:1"), "?": ("untyped", "untyped")}
    for second in ('{"type": "Number"}', '{"type": "Number", "is": ["A"]}'):
        with pytest.raises(ValueError, match="twice.jsonl:2: type Number"):
            programs.load_program(spark, put("twice.jsonl", '{"type": "Number"}', second))
    with pytest.raises(ValueError, match="unknown statement"):
        programs.load_program(spark, put("odd.jsonl", '{"what": 1}'))
    again = put("again.jsonl", *programs.program_lines(rules.SCIENCE))
    loaded = programs.load_program(spark, again)
    assert loaded.rules == rules.SCIENCE.rules and loaded.edges == rules.SCIENCE.edges and loaded.guidelines == rules.SCIENCE.guidelines
