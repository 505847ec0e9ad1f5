import json

from hybridkb.llm.html_wrapper import _tuples, align, extract_main_text, fold, infer, main_text, plan

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>x</p>";</script></head><body><nav><ul><li><a href="/a>b">A</a></li><li>B</li></ul></nav>
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>One   two<br>three</p><div class="sidebar">no</div><p>Fo<b>ur</b>&eacute;&lt;<form>x<input></form>
<ul><li>i<li>j</ul><section class="comments"><p>me too</p></section></article><footer>&copy; x</footer></body></html>"""


def test_folding_and_alignment_give_one_union_free_expression():
    assert fold(list("abababc")) == [("+", ("a", "b")), "c"]
    a, b = fold(["<p>", "#", "</p>"] * 3), fold(["<p>", "#", "</p>"])
    assert align(a, b) == a and align(b, a) == a
    assert align(["a", "c"], ["a", "b", "c"]) == ["a", ("?", ("b",)), "c"]
    one = infer([json.dumps(["a", "c"]), json.dumps(["a", "b", "c"])])
    assert _tuples(json.loads(one)) == ("a", ("?", ("b",)), "c")


def test_article_without_the_rest(spark):
    pages = spark.createDataFrame([(1, "http://h/1", PAGE, "x"), (2, "http://h/2", PAGE.replace("<nav>", "<nav><p>z</p>"), "x"), (3, None, None, "x"), (4, "odd", "", "x"), (None, "http://h/3", "<p>only", "x"), (1, "http://h/1", PAGE, "x")], "page_id long, url string, html string, wrapper string")
    rows = extract_main_text(pages).collect()
    text = "Title & more\nOne two\nthree\nFouré<\ni\nj"
    got = [(r.page_id, r.text, r.n_chars) for r in rows]
    assert sorted(got, key=str) == sorted([(1, text, len(text)), (1, text, len(text)), (2, text, len(text)), (3, "", 0), (4, "", 0), (None, "only", 4)], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_table_has_the_articles_blocks(spark, data):
    import html
    import re

    for r in extract_main_text(spark.read.parquet(f"{data}/pages.parquet")).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_plan_and_single_pages():
    assert plan("[]") == ("", frozenset())
    assert main_text("<div>a</div><div>b<span>c</span></div>", "[]") == "a\nbc"
