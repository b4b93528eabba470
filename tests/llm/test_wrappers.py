"""Wrapper induction: what alignment alone decides, and pages of any length, width and depth."""

import time
from itertools import product

import pytest

from eventlens.llm import html


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def page(i, n=40, times=1):
    """No article element, and no class or id that tells anything."""
    body = "".join(f"<p>{words(f'{i}y{k}', n)}</p>" for k in range(times))
    return f"<html><body><div class=x1><p>Our site, our slogan</p><ul><li>One<li>Two</ul></div><div class=x2><h2>Title {i}</h2>{body}</div><div class=x3>Copyright 2024</div></body></html>"


@pytest.mark.parametrize("n, times", [(40, 1), (60, 700)])
def test_the_wrapper_alone_tells_template_from_content(n, times):
    """Switching the wrapper off changes every page; length makes no difference."""
    pages = [page(i, n, times) for i in range(6)]
    w = html.induce(pages)
    for i, p in enumerate(pages):
        want = "\n\n".join([f"Title {i}", *[words(f"{i}y{k}", n) for k in range(times)]])
        assert html.extract(p, w) == want
        assert html.extract(p) == f"Our site, our slogan\n\nOne\n\nTwo\n\n{want}\n\nCopyright 2024"


def test_long_pages_shape_wrappers_in_the_query(spark):
    rows = [(i, f"http://h.example/{i}", page(i, 60, 700)) for i in range(6)] + [(10 + i, f"http://k.example/{i}", page(i)) for i in range(6)]
    assert len(rows[0][2]) > 200_000
    for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.startswith("Title") and "slogan" not in r.text and "Copyright" not in r.text


def test_menus_and_footers_are_aligned_too():
    """Template texts in nav and footer count as matched; what varies in them stays out by its tag."""
    pages = [f"<body><nav><a>Home</a><a>{i}</a></nav>{page(i)}<footer>Imprint</footer></body>" for i in range(4)]
    a, b = html._tree(html.parse(pages[0])), html._tree(html.parse(pages[1]))
    assert {x.text for x, _ in html._Matching(a, b).equal_texts()} >= {"Home", "Imprint", "Copyright 2024"}
    assert html.extract(pages[2], html.induce(pages)) == f"Title 2\n\n{words('2y0', 40)}"


def test_an_articles_own_header_stays():
    assert html.extract("<body><header>Site</header><article><header><h1>Head</h1></header><p>text</p></article></body>") == "Head\n\ntext"


def brute(a, b):
    """The weight of the largest matching, by the plain recursion."""
    if a.label != b.label:
        return 0.0
    if a.node is None:
        return 2.0 if a.text == b.text else 1.0
    m = [[0.0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for (i, x), (j, y) in product(enumerate(a.kids, 1), enumerate(b.kids, 1)):
        m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute(x, y))
    return 1.0 + m[-1][-1]


PARTS = ["<p>a</p>", "<p>b</p>", "<div><p>a</p>c</div>", "<ul><li>1<li>2</ul>", "<div><div>x</div></div>", "t"]


@pytest.mark.parametrize("seed", range(30))
def test_matchings_are_the_largest(seed):
    import random

    rng = random.Random(seed)
    a, b = (html._tree(html.parse("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 7))))) for _ in range(2))
    assert html._Matching(a, b)._weight(a, b) == brute(a, b)


@pytest.mark.parametrize("pages", [
    ["<body>" + "".join(f"<p>{words(f'{i}q{j}', 2)}</p>" for j in range(3000)) + "</body>" for i in range(8)],
    ["<body>" + "".join(f"<div><p>{words(f'{i}q{j}', 2)}</p><b>{j % 3}</b></div>" for j in range(3000)) + "</body>" for i in range(8)],
    ["<body>" + "<div>" * 3000 + words(i, 5) + "</div>" * 3000 + "</body>" for i in range(4)],
], ids=["wide", "wide and nested", "deep"])
def test_wide_and_deep_pages_end(pages):
    began = time.monotonic()
    w = html.induce(pages)
    text = html.extract(pages[0], w)
    assert words("0q0", 2) in text or words(0, 5) == text
    assert time.monotonic() - began < 60


def test_deep_parts_are_aligned():
    pages = [f"<body>{'<div>' * 100}<div class=k>Deep slogan</div><p>{words(i, 30)}</p>{'</div>' * 100}</body>" for i in range(6)]
    assert html.extract(pages[1], html.induce(pages)) == words(1, 30)


def test_siblings_beyond_the_table_are_matched_by_their_equal_parts(monkeypatch):
    monkeypatch.setattr(html, "CELLS", 4)
    pages = [page(i, 10, 30) for i in range(6)]
    assert html.extract(pages[2], html.induce(pages)).startswith("Title 2\n\n") and "slogan" not in html.extract(pages[2], html.induce(pages))


def test_rare_layouts_of_large_hosts_have_wrappers(spark):
    """Three pages of another layout among 300: a sample of the host alone would hardly meet them."""
    shop = lambda i: f"<body><div class=y1>Our shop, our slogan</div><table class=y2><tr><td>Thing {i}</td><td>{words(f's{i}', 30)}</td></tr></table><center>Imprint</center></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(300)] + [(1000 + i, f"http://h.example/s{i}", shop(i)) for i in range(3)]
    out = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[1000 + i] == f"Thing {i}\n\n{words(f's{i}', 30)}" for i in range(3))
    assert all(out[i] == f"Title {i}\n\n{words(f'{i}y0', 40)}" for i in range(300))


def article(i, inner):
    return f"<body><div class=top>Our site</div><article>{inner}</article><div class=end>Imprint</div></body>".replace("#", str(i))


@pytest.mark.parametrize("inner, want", [
    (lambda i: f"<section class=intro><p>{words(f'{i}a', 40)}</p></section><section class=discussion><p>{words(f'{i}b', 40)}</p></section><div class=related-work><p>{words(f'{i}c', 50)}</p></div>", lambda i: [words(f"{i}a", 40), words(f"{i}b", 40), words(f"{i}c", 50)]),
    (lambda i: f"<p>{words(f'{i}a', 40)}</p><p class=alert>{words(f'{i}b', 9)}</p><p>{words(f'{i}c', 20)}</p>", lambda i: [words(f"{i}a", 40), words(f"{i}b", 9), words(f"{i}c", 20)]),
    (lambda i: f"<p>{words(f'{i}a', 40)}</p><p class=notice>We use biscuits</p>", lambda i: [words(f"{i}a", 40)]),
    (lambda i: f"<p>{words(f'{i}a', 40)}</p><div class=comments><p>{words(f'{i}b', 9)}</p></div><div class=ad-slot>{words(f'{i}c', 5)}</div>", lambda i: [words(f"{i}a", 40)]),
    (lambda i: f"<h1>Head {i}</h1><p>{words(f'{i}a', 40)}</p><p>{words(f'{i}b', 30)}</p><p>Copyright by us, all rights reserved</p>", lambda i: [f"Head {i}", words(f"{i}a", 40), words(f"{i}b", 30)]),
])
def test_varying_slots_overrule_names_and_constant_ones_are_template(inner, want):
    pages = [article(i, inner(i)) for i in range(8)]
    w = html.induce(pages)
    assert [html.extract(p, w) for p in pages] == ["\n\n".join(want(i)) for i in range(8)]


def test_a_page_alone_keeps_the_parts_of_its_article():
    inner = f"<section class=intro><p>{words('a', 40)}</p></section><section class=discussion><p>{words('b', 40)}</p></section><div class=comments>{words('c', 5)}</div>"
    assert html.extract(article(1, inner)) == f"{words('a', 40)}\n\n{words('b', 40)}"


def test_a_paragraph_that_most_pages_share_is_content():
    pages = [article(i, f"<p>{words(f'{i}a', 40)}</p><p>{'shared words' if i else 'other words'}</p><p>{words(f'{i}b', 30)}</p>") for i in range(8)]
    w = html.induce(pages)
    assert all("shared words" in html.extract(p, w) for p in pages[1:])


def plain_parse(page):
    """The same tree by plain walks over all open elements."""
    root = html.Node("#root")
    stack, at = [root], 0
    while at < len(page):
        m = html._TOKEN.match(page, at)
        at = m.end()
        close, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].kids.append(m[0])
            continue
        tag = tag.lower()
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in html.BLOCK and stack[i].tag in html.BLOCK:
                    break
            continue
        if tag in html.BLOCK:
            ends, bounds = html.ENDS.get(tag, (frozenset("p"), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends or stack[i].tag == "p":
                    del stack[i:]
                    if tag not in html.ENDS:
                        break
                elif stack[i].tag in bounds or (stack[i].tag in html.BLOCK and tag not in html.ENDS):
                    break
        node = html.Node(tag)
        stack[-1].kids.append(node)
        if tag not in html.VOID and not raw.endswith("/"):
            stack.append(node)
    return root


def shape(node):
    return node if isinstance(node, str) else (node.tag, [shape(k) for k in node.kids])


@pytest.mark.parametrize("seed", range(40))
def test_the_tree_is_that_of_plain_walks(seed):
    import random

    rng = random.Random(seed)
    tags = ["p", "div", "b", "i", "ul", "li", "table", "tr", "td", "th", "span", "dl", "dt", "dd", "br", "article"]
    page = "".join(rng.choice(["<{}>", "<{}>", "</{}>", "text", "<{}/>"]).format(rng.choice(tags)) for _ in range(200))
    assert shape(html.parse(page)) == shape(plain_parse(page))


@pytest.mark.parametrize("part", ["<i>x</b>", "<b><div><i>x</i></b>", "<i>x<li>", "<table><td>x</tr>", "<p><span>x</div>", "<div><dd>x</dt>"])
def test_misnested_tags_take_linear_time(part):
    began = time.perf_counter()
    html.parse(part * 30_000)
    assert time.perf_counter() - began < 5


def test_main_text_of_made_hosts_is_what_was_put_in(spark):
    """Hosts with templates of their own, and what each page's article says: every page gives that and nothing else."""
    import random

    rng = random.Random(11)
    rows, want = [], {}
    for h in range(6):
        box = rng.choice(["article", "main", "div class=x1"])
        menu = "".join(f"<li><a href=/{k}>menu {h} {k}</a></li>" for k in range(rng.randrange(2, 6)))
        foot = rng.choice(["<footer>&copy; host</footer>", "<div class=f>Imprint of the host</div>"])
        for i in range(10):
            key = h * 100 + i
            parts = [f"Title {key} &amp; more", *[words(f"{key}z{k}", rng.randrange(5, 40)) for k in range(rng.randrange(2, 8))]]
            body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}" + rng.choice(["</p>", ""]) for p in parts[1:])
            page = f"<html><head><title>t{key}</title><script>var x='<p>';</script></head><body><nav><ul>{menu}</ul></nav><{box}>{body}</{box.split()[0]}><div class=ad>buy {key}</div><aside>see {key}</aside>{foot}</body></html>"
            rows.append((key, f"http://h{h}.example/{i}", page))
            want[key] = "\n\n".join([f"Title {key} & more", *parts[1:]])
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want
