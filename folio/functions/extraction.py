"""Main content of a page: selectors first, then two published ways to tell content from boilerplate.

Without a selector that matches, blocks are classified by text and link density (Kohlschütter et al., Boilerplate
Detection using Shallow Text Features, 2010); after that, by paragraph scores that parents inherit; last comes the
body. The second and third way stand in for libraries and give their labels, not their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from folio.functions import constants as C
from folio.functions.dom import Node, parse

_BLOCKS = frozenset("p li pre blockquote td th h1 h2 h3 h4 h5 h6 dd dt".split())


@dataclass(frozen=True)
class Extractor:
    content: tuple[str, ...] = tuple(C.CONTENT_SELECTORS)
    remove: tuple[str, ...] = tuple(C.REMOVE_SELECTORS)
    least: int = C.MIN_CONTENT_LENGTH
    include_tables: bool = True
    include_images: bool = True
    include_links: bool = True
    _kept: frozenset = field(default=frozenset(C.PRESERVE_TAGS) | {"img", "br", "hr"}, repr=False)

    def _clean(self, root: Node) -> None:
        for selector in self.remove:
            for node in root.select(selector):
                node.remove()

    def _drop_empty(self, root: Node) -> None:
        """Leaves first, so that a container goes only if all in it was empty."""
        for node in reversed(list(root.elements())):
            if node.name not in self._kept and not node.text(strip=True) and not node.find("img", "video", "audio", "iframe"):
                node.remove()

    def _selected(self, root: Node) -> Node | None:
        for selector in (*self.content, *C.CONTENT_FALLBACKS):
            if (node := root.select_one(selector)) is not None:
                return node
        return None

    def _allowed(self, node: Node) -> Node:
        gone = [n for n, ok in (("table", self.include_tables), ("img", self.include_images)) if not ok]
        for x in node.find_all(*gone) if gone else []:
            x.remove()
        if not self.include_links:
            for x in node.find_all("a"):
                x.name = "span"
        return node

    def extract(self, html: str | None) -> dict | None:
        """title, description, text, method and the content's node; None for a blank page or one without content."""
        if not html or not html.strip():
            return None
        root = parse(html)
        self._clean(root)
        found = root.find("title")
        title = found.text(strip=True) if found else None
        meta = next((n for n in root.find_all("meta") if n.attrs.get("name", "").lower() == "description"), None)
        description, method = None, "css_selector"
        node = self._selected(root)
        size = len(node.text(" ", strip=True)) if node else 0
        if not node or not size or size < self.least:
            for method, way in (("trafilatura", by_density), ("readability", by_paragraphs)):
                node = way(self._allowed(_copy(root)))
                if node is not None:
                    if method == "trafilatura" and meta is not None:
                        description = meta.attrs.get("content")
                    text = node.text(" ", strip=True)
                    if not text or len(text) >= self.least:
                        break
                    node = None
            else:
                method, node = "beautifulsoup", self._selected(root) or root.find("body")
        if node is None:
            return None
        node.remove()
        top = Node("#root")
        top.append(node)
        self._clean(top)
        self._drop_empty(top)
        text = top.text(" ", strip=True)
        if text and len(text) < self.least:
            top, text = Node("#root"), ""
        return {"node": top, "title": title, "description": description, "text": text, "method": method}


def _density(node: Node) -> tuple[int, float]:
    """Words, and the share of them in links."""
    words = len(node.text(" ").split())
    linked = sum(len(a.text(" ").split()) for a in node.find_all("a"))
    return words, linked / words if words else 1.0


def by_density(root: Node) -> Node | None:
    """The blocks that the densities of a block and its neighbours call content."""
    body = root.find("body") or root
    blocks = [n for n in body.elements() if n.name in _BLOCKS and not any(c.name in _BLOCKS for c in n.elements())]
    if not blocks:
        return None
    seen = [_density(n) for n in blocks]
    none = (0, 0.0)
    out = Node("article")
    for k, node in enumerate(blocks):
        (words, linked), before, after = seen[k], seen[k - 1] if k else none, seen[k + 1] if k + 1 < len(seen) else none
        if linked > 0.333:
            good = False
        elif before[1] <= 0.555:
            good = words > 16 or after[0] > 15 or before[0] > 4
        else:
            good = words > 40 or after[0] > 17
        if good or node.name[0] == "h" and node.name[1:].isdigit() and after[0] > 15:
            out.append(_copy(node))
    return out if out.children else None


def _copy(node: Node) -> Node:
    new = Node(node.name, dict(node.attrs), node.data)
    for child in node.children:
        new.append(_copy(child))
    return new


def by_paragraphs(root: Node) -> Node | None:
    """The element whose paragraphs score best: a point each, for commas and for length; half goes one level up."""
    scores: dict[int, tuple[float, Node]] = {}

    def add(node: Node | None, points: float) -> None:
        if node is not None and node.name not in ("", "#root", "html"):
            scores[id(node)] = (scores.get(id(node), (0.0, node))[0] + points, node)

    for p in root.find_all("p", "pre", "td"):
        text = p.text(" ", strip=True)
        if len(text) >= 25:
            points = 1 + text.count(",") + min(len(text) // 100, 3)
            add(p.parent, points)
            add(p.parent.parent if p.parent else None, points / 2)
    if not scores:
        return None
    return _copy(max(scores.values(), key=lambda x: x[0] * (1 - _density(x[1])[1]))[1])
