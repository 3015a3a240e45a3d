"""Wrappers on pages whose article is not one plain element."""

import pytest

from matchbook.llm import wrappers


def _host(pages):
    """Rules of a host, inferred page by page as a task does."""
    merged = None
    for page in pages:
        own = wrappers.wrapper_of(wrappers.parse(page))
        merged = own if merged is None else wrappers.merge(merged, own)
    return wrappers.rules_of(merged)


@pytest.mark.parametrize("n", [2, 5])
@pytest.mark.parametrize("tag", ["article", "div class='content'", "section class='entry'"])
@pytest.mark.parametrize("between", ["", "<aside>Advert</aside>"])
def test_article_in_siblings(n, tag, between):
    name = tag.split()[0]

    def page(i):
        parts = between.join(f"<{tag}><p>Page {i} part {k} {'and so on ' * k}ends.</p></{name}>" for k in range(n))
        hidden = f"<{tag} hidden><p>Hidden {i}</p></{name}>"
        return f"<body><nav>Menu</nav>{parts}{hidden}<footer>Imprint</footer></body>"

    rules = _host([page(i) for i in range(4)])
    for i in range(4):
        assert wrappers.extract(page(i), rules) == " ".join(
            f"Page {i} part {k} {'and so on ' * k}ends." for k in range(n))


def _page(i, notice="<div>Always the same notice.</div>"):
    return (f"<body><article><h1>Title</h1>{notice}<p>Body {i} of a page, {'more ' * (i % 7)}words.</p><p>End {i}.</p></article></body>")


@pytest.mark.parametrize("error", [None, "<body><p>Error 500</p></body>", "<body><article><h1>Error</h1></article></body>",
                                   _page(9999, "<div>Another notice.</div>")])
@pytest.mark.parametrize("n", [2, 19, 20, 200])
def test_template_at_any_number_of_pages(n, error):
    pages = [_page(i) for i in range(n)]
    at_place = error is not None and "Another" in error
    pages[n // 2:n // 2] = [error] if error else []
    rules = _host(pages)
    template = n > 2 or not at_place  # one page of three says otherwise: undecided, so nothing is dropped
    for i in (0, n - 1):
        notice = "" if template else " Always the same notice."
        assert wrappers.extract(_page(i), rules) == f"Title{notice} Body {i} of a page, {'more ' * (i % 7)}words. End {i}."
    if at_place:
        assert "Another notice." in wrappers.extract(error, rules)


def test_copies_make_no_template():
    a, b = _page(1, "<div>Only here.</div>"), _page(2, "")
    for pages in ([a, a], [a] * 25, [a, a, a, b], [b, *[a] * 30]):
        assert "Only here." in wrappers.extract(a, _host(pages))


@pytest.mark.parametrize("depth", [59, 60, 61, 200, 3000])
@pytest.mark.parametrize("closed", [True, False])
def test_deep_pages(depth, closed):
    """Menus inside are dropped and the article ends at its end tag, however deep it stands."""
    def page(i):
        mark = "<center><div>" * (depth // 2)
        end = "</div></center>" * (depth // 2) if closed else ""
        inside = f"{mark}<p>Body {i}.</p><nav><div>Menu</div></nav><form><p>Send</p></form>{end}"
        return (f"<body><div class='x'>{mark}<article><h1>Title</h1>{inside}<p>End {i}.</p></article>{end}</div>"
                f"<div class='comments'><p>Comment {i}</p></div><footer>Footer</footer></body>")

    rules = _host([page(i) for i in range(3)])
    for i in range(3):
        assert wrappers.extract(page(i), rules) == f"Title Body {i}. End {i}."


def test_packed_wrappers():
    own = wrappers.wrapper_of(wrappers.parse("<div>" * 2000 + "<p>a</p><p>b</p><ul><li>c</ul>"))
    back, todo = wrappers.unpack(wrappers.pack(own)), []
    todo.append((own, back))
    while todo:
        a, b = todo.pop()
        assert a[:wrappers.CHILDREN] == b[:wrappers.CHILDREN] and len(a[-1]) == len(b[-1])
        todo += zip(a[-1], b[-1])
