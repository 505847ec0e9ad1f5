import pytest

from hybridkb.llm.html_wrapper import align, covers, expression, extract_main_text, infer, main_text, plan


def test_every_expression_of_a_host_is_aligned():
    marks = ["<b>x</b>", "<i>x</i>", "<u>x</u>"]
    bodies = ["".join(f"<h2>{marks[n // 3**k % 3]}</h2><p>t</p>" for k in range(5)) for n in range(120)]
    pages = [f'<body><div class="content"><div class="post">{b}</div></div></body>' for b in bodies]
    short = '<body><div class="content"><p>first</p><div class="post"><p>t</p></div></div></body>'
    wrapper = infer([expression(p) for p in [*pages, short]])
    assert plan(wrapper)[0] == "div.content" and main_text(short, wrapper) == "first\nt"
    parts = [infer([expression(p) for p in [*pages, short][k::7]]) for k in range(7)]
    assert plan(infer(parts))[0] == "div.content"


def test_covered_items_add_nothing():
    wrapper = ["a", ("?", ("b",)), ("+", ("c", ("?", ("d",))))]
    for items in (["a", "c"], ["a", "b", "c", "d", "c"], ["a", "c", "c", "d"]):
        assert covers(wrapper, items) and align(wrapper, items) == wrapper
    assert not covers(wrapper, ["a", "b"]) and not covers(wrapper, ["a", "d"])


def test_names_around_the_article_or_on_it_drop_nothing():
    article = '<article{}><h1>T</h1><p>a</p><p>b</p><aside>no</aside></article>'
    rest = '<div class="comments"><article class="comment"><b>me</b><p>c</p></article></div>'
    for page in (
        f'<body class="has-sidebar"><nav>n</nav>{article.format("")}{rest}</body>',
        f'<body class="sidebar"><nav>n</nav>{article.format("")}{rest}</body>',
        f'<body><div id="page" class="with-sidebar"><nav>n</nav>{article.format("")}{rest}</div></body>',
        f'<body><div class="search sidebar">{article.format("")}{rest}</div></body>',
        f'<body><a>skip</a>{article.format(" class=" + chr(34) + "post social" + chr(34))}{rest}</body>',
        f'<body>{article.format("").replace("article", "div class=content-x", 1).replace("content-x", chr(34) + "content sidebar-right" + chr(34)).replace("/article", "/div")}</body>',
    ):
        wrapper = infer([expression(page)])
        assert main_text(page, wrapper) == "T\na\nb", page
    teaser = '<body><h1>T</h1><p>a</p><p>b</p><aside class="related"><article class="teaser"><p>x</p></article></aside></body>'
    assert main_text(teaser, infer([expression(teaser)])) == "T\na\nb"


def test_names_that_only_contain_listed_words_drop_nothing():
    page = (
        '<body><article><p>a</p><div class="share-price"><p>b</p></div><div class="search-results"><p>c</p></div><div class="adventure menu-planning"><p>d</p></div>'
        '<header class="post-header"><h2>e</h2></header><div class="ad-slot">x</div><div id="cookie_notice">x</div><ul class="share-buttons"><li>x</ul><section class="reader-comments"><p>x</p></section>'
        '<div class="related posts">x</div><div role="navigation">x</div></article></body>'
    )
    assert main_text(page, expression(page)) == "a\nb\nc\nd\ne"


@pytest.mark.parametrize("n", [1, 2, 3, 50])
@pytest.mark.parametrize("holder", ["article", "main", "div class=content", "section"])
def test_shared_paragraphs_stay_on_hosts_of_any_size(spark, n, holder):
    name = holder.split()[0]
    intro = '<p class="intro">The series so far</p>'
    body = f'<body><ul><li><a href=/>home</a></li><li><a href=/b>more</a></li></ul><{holder}><h1>T{{0}}</h1>{intro}<p>text {{0}}</p><div class="kx">Same words</div></{name}></body>'
    rows = [(k, f"http://h{n}{name}/{k}", body.format(k)) for k in range(n)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"T{k}\nThe series so far\ntext {k}\nSame words" for k in range(n)}
    if holder == "section":  # nothing names the article: of the page, lists of links alone are left out
        assert all(got[k].endswith(want[k]) for k in want)
    else:
        assert got == want


def test_quotes_open_values_behind_equals_signs_only():
    for page, want in [
        ("<article><p>It's <a title=it's href=x>one</a> two</p><p>three isn't four</p></article>", "It's one two\nthree isn't four"),
        ("<article><p a'b=c class=x>one</p><p title='a > b'>two</p><p title=\"it's >\">three</p></article>", "one\ntwo\nthree"),
        ("<article><p title= 'x>y' d>one</p><p =x>two</p><p data-class=nav data-id='ad'>three</p><p title=\"class=nav\">four</p></article>", "one\ntwo\nthree\nfour"),
        ("<article><p title=\"never closed>one</p><p>two</p></article>", "one\ntwo"),
        ("<article><p>a < b and c > d <3</p><p class>e</p", "a < b and c > d <3\ne"),
    ]:
        assert main_text(page, expression(page)) == want, page


def test_lists_of_links_are_menus_where_no_element_holds_the_article():
    page = '<body><div class="kw"><ul><li><a>A</a></li><li><a>B</a></li></ul></div><p>text <a>with link</a></p><p>more</p></body>'
    assert main_text(page, expression(page)) == "text with link\nmore"
