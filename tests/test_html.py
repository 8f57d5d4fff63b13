"""DOM, Markdown, extraction and API schemas on hand-written pages."""

from __future__ import annotations

import pytest

from folio.functions import dom, openapi
from folio.functions.dom import parse
from folio.functions.extraction import Extractor
from folio.functions.markdown import html_to_markdown
from folio.operators.patterns import KNOWN, PatternRegistry, SitePattern, fetch_settings, with_pattern

LONG = "word " * 40


@pytest.mark.parametrize(
    ("html", "selector", "texts"),
    [
        ('<ul><li class="x y">1<li>2</ul>', "ul > li.x.y, li", ["1", "2"]),
        ('<div role="main"><p>a<p>b</div>', '[role="main"] p', ["a", "b"]),
        ('<main class="a docMainContainer_x">t</main>', 'main[class*="docMainContainer"]', ["t"]),
        ('<a role="tab" aria-selected="true">on</a><a role="tab">off</a>', '[role="tab"][aria-selected="true"]', ["on"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "tr td", ["1", "2", "3"]),
        ("<p><b>open<br>more<p>next", "p", ["openmore", "next"]),
    ],
)
def test_selectors_and_repair(html, selector, texts):
    assert [n.text() for n in parse(html).select(selector)] == texts


def test_scope_and_text():
    root = parse("<div> a <script>no</script><ul><li>1<ul><li>2</ul></ul> b&amp c&copy;</div><!-- gone -->")
    assert [n.name for n in root.find("ul").select(":scope > li")] == ["li"]
    assert root.text(" ", strip=True) == "a 1 2 b& c©"


def test_references_need_their_semicolon():
    root = parse("<title>a = &quot</title><p>&quot;b&quot; &amp;c &ampd &copy2 &#39e &#39; &lt<i>&nosuch; x && y</i><a href='?a&lt=1&amp;b'>z</a><script>x&lt</script>")
    assert root.find("title").text() == "a = &quot"
    assert root.find("p").text() == "\"b\" &c &d &copy2 &#39e ' &lt&nosuch; x && yz"
    assert root.find("a").attrs == {"href": "?a&lt=1&b"}
    assert root.find("script").text() == "x&lt"


@pytest.mark.parametrize(
    ("html", "plain"),
    [
        ('<!DOCTYPE html><DIV Class="X x" class="y" hidden>a &lt; b<br/><!-- c - d --><p>one<p>two</div><script>x()</script>tail &am', True),
        ("<title>t</title><ul><li>a<li>b</ul></p><i/>x", True),
        ("", True),
        ("<p class=x>a", False),
        ("<p>a < b", False),
        ("<a href='x'>a</a>", False),
        ("<!-- a--b -->x", False),
        ("<script>'</p>'</script>x", False),
        ('<a href="?a&amp;b">x</a>', False),
    ],
)
def test_plain_pages_are_read_as_the_library_reads_them(html, plain):
    def tree(n):
        return n.name, list(n.attrs.items()), n.data, [tree(c) for c in n.children]

    builder = dom._Builder()
    builder.feed(html)
    builder.close()
    found = dom._plain(html)
    assert (found is not None) == plain
    assert tree(dom.parse(html)) == tree(builder.tree.done())


def test_selectors_follow_changes_of_the_tree():
    root = dom.parse('<div class="x"><p class="x y">a</p></div><p class="x">b</p><p role="tab">c</p>')
    assert [n.name for n in root.select(".x")] == ["div", "p", "p"]
    root.select_one("div").remove()
    assert [n.text() for n in root.select(".x")] == ["b"] and root.select_one(".y") is None
    assert [n.text() for n in root.select('.y, [role="tab"]')] == ["c"]


def test_unsupported_selector_is_refused():
    with pytest.raises(ValueError, match="not supported"):
        parse("<p>").select("p:nth-child(2)")


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>Title_x</h2><p>a <strong>b</strong> <em>c</em><br>d</p>", "## Title\\_x\n\na **b** *c*  \nd"),
        ("<ul><li>one<ul><li>in</li></ul></li><li>two</li></ul>", "- one\n  - in\n- two"),
        ("<ol start='3'><li>x<li>y</ol>", "3. x\n4. y"),
        ('<pre><code class="language-go">x := 1\n</code></pre>', "```go\nx := 1\n```"),
        ('<pre><code class="lang-py">a</code></pre>', "```py\na\n```"),
        ('<pre><code class="sql">a</code></pre>', "```sql\na\n```"),
        ("<pre>plain</pre>", "```\nplain\n```"),
        ("<p><code>a`b</code> and <code>c</code></p>", "`` a`b `` and `c`"),
        ('<a href="/c"><h3>Card</h3><p>about</p></a>', "- **[Card](/c)** - about"),
        ('<a href="/c"><h3>Card</h3></a>', "- **[Card](/c)**"),
        ("<table><tr><th>a<th>b|c<tr><td>1<td><ul><li>p<li>q|r</ul><tr><th>a<th>b|c</table>", "| a | b\\|c |\n| --- | --- |\n| 1 | - p<br>- q\\|r |"),
        ("<table><thead><tr><td>h</td></tr></thead><tbody><tr><td>v</td></tr></tbody></table>", "| h |\n| --- |\n| v |"),
        (f'<img src="s.png" alt="{"z" * 101}" title="t">', f'![{"z" * 97}...](s.png "t")'),
        ("<img alt='x'><svg><title>t</title></svg><p>ok</p>", "ok"),
        ("<blockquote><p>q</p><p>r</p></blockquote><hr>", "> q\n>\n> r\n\n---"),
        ('<pre class="openapi__method-endpoint"><span class="badge">get</span><h2>/a/b</h2></pre>', "**GET** `/a/b`"),
        ("", ""),
    ],
)
def test_markdown(html, markdown):
    assert html_to_markdown(html) == markdown


def test_extraction_takes_selectors_in_order():
    page = f"<title> T </title><body><nav>n</nav><main>{LONG}</main><article>{LONG}two<p></p><img src=x></article></body>"
    found = Extractor().extract(page)
    assert found["title"] == "T" and found["method"] == "css_selector" and found["text"].endswith("two")
    assert [n.name for n in found["node"].elements()] == ["article", "img"]


def test_extraction_falls_back_and_gates():
    assert Extractor().extract("  ") is None
    body = "".join(f"<p>{LONG}{k}</p>" for k in range(3))
    dense = Extractor().extract(f"<body><div>{body}</div><ul><li><a href=x>link only</a></ul></body>")
    assert dense["method"] == "trafilatura" and "link only" not in dense["text"]
    short = Extractor().extract("<body><article>tiny</article></body>")
    assert short["method"] == "beautifulsoup" and short["text"] == "" and short["node"].html() == ""


def test_selected_content_needs_the_configured_length():
    """An article over 100 characters but under the least length gives way to the next method."""
    rest = "".join(f"<p>{LONG}{k}</p>" for k in range(6))
    page = f"<body><article><p>{LONG[:150].ljust(150, 'x')}</p></article><div>{rest}</div></body>"
    assert Extractor().extract(page)["method"] == "css_selector"
    found = Extractor(least=400).extract(page)
    assert found["method"] == "trafilatura" and len(found["text"]) >= 400


def test_switches():
    page = f"<body><p>{LONG}<a href=x>l</a><table><tr><td>cell</table>{LONG}</p></body>"
    found = Extractor(include_tables=False, include_links=False).extract(page)
    assert "cell" not in found["text"] or found["method"] == "beautifulsoup"


def test_patterns_stand_before_the_defaults():
    registry = PatternRegistry()
    docusaurus = registry.get("docusaurus")
    merged = with_pattern(Extractor(), docusaurus)
    assert merged.content[0] == "article.markdown" and "article" in merged.content
    assert fetch_settings({"use_js": False}, docusaurus)["use_js"] and not fetch_settings({"use_js": False}, registry.get("sphinx"))["use_js"]
    registry.register(SitePattern("mine", content_selectors=(".m",)))
    assert len(registry.list_patterns()) == len(KNOWN) + 1 and registry.get("none") is None


API = """<h1 class="openapi__heading">Get it</h1><div class="openapi__method-endpoint"><span class="badge">post</span><h2>/v1/x</h2></div>
<details class="openapi-markdown__details response"><summary>Schema</summary><ul>
<li class="openapi-schema__list-item"><strong class="openapi-schema__property">id</strong><span class="openapi-schema__name">integer</span><span class="openapi-schema__required">required</span><p>The a|b</p></li>
<li class="openapi-schema__list-item"><strong class="openapi-schema__property">box</strong><p>Holds</p><ul><li class="openapi-schema__list-item"><strong class="openapi-schema__property">in</strong><p>x</p><strong>Example:</strong> <code>7</code></li></ul></li>
</ul></details>
<div role="tabpanel"><div class="openapi-schema__list-item"><strong class="openapi-schema__property">other</strong></div></div>
<div class="openapi-security__details"><div class="openapi-security__summary-header">Auth: oauth2</div><pre><span><strong>name:</strong> key</span><span><strong>flows:</strong> <code>{"a": {"tokenUrl": "http://t"}}</code></span></pre></div>
<div class="openapi-tabs__code-container"><div data-tab-label="curl"><code><span class="token-line">curl x</span><span class="token-line"> -d</span></code></div></div>"""


def test_api_schema():
    found = openapi.extract_schema(API)
    assert found["title"] == "Get it"
    text = found["markdown"]
    for part in (
        "# Get it",
        "**POST** `/v1/x`",
        "## Response Schema\n\n| Field | Type | Description |",
        "| `id` | integer | The a\\|b **(required)** |",
        "| `box` | object | Holds |",
        "### box object\n\n| Field | Type | Description | Example |",
        "| `in` |  | x | `7` |",
        "| `other` |  |  |",
        "**Auth: oauth2**",
        "- **name:** key",
        "- **Token URL:** http://t",
        "```curl\ncurl x\n -d\n```",
    ):
        assert part in text, part


def test_api_schema_needs_more_than_a_title():
    assert openapi.extract_schema("<h1>t</h1>") is None and openapi.extract_schema(None) is None


def test_live_tabs_and_the_panel_that_shows():
    tabs = '<div role="tablist"><i role="tab" aria-controls="p1">python</i><i role="tab" aria-selected="true">ruby</i></div>'
    live = parse(f'<div class="openapi-tabs__code-container">{tabs}<div id="p1"><code>print(1)</code></div></div>')
    assert "```python\nprint(1)\n```" in openapi.code_samples(live)
    shown = parse(f'<div class="openapi-tabs__code-container">{tabs}<div role="tabpanel"><code>puts 1</code></div></div>')
    assert "```ruby\nputs 1\n```" in openapi.code_samples(shown)
