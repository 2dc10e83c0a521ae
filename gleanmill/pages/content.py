"""What a recipe reads from one parsed page."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from gleanmill.functions.patterns import SPACE_CHARS
from gleanmill.pages.tree import Node, Selector

# Tags whose text runs on in the line.
INLINE = {
    "span", "a", "em", "strong", "b", "i", "u", "small", "label", "abbr", "cite", "q", "sub", "sup", "code", "time",
}
# What a cleaned page does without.
CHROME = {"script", "style", "noscript", "iframe", "header", "footer", "nav", "aside", "meta"}
CONSENT = ("cookie", "consent", "gtm")
MEDIA = {"img", "video", "audio", "picture", "source", "object", "embed", "canvas"}


def strip(text: str) -> str:
    return text.strip(SPACE_CHARS)


def one_line(text: str) -> str:
    return strip(re.sub(r"\s+", " ", text))


def table_rows(table: Node) -> tuple[list[str], list[list[str]]]:
    """Header cells and body rows; a body without tbody counts as one."""
    def cells(row: Node, tag: str) -> list[str]:
        return [strip(c.text()) for c in row.walk() if c.tag == tag]

    heads, rows = [], []
    for part in table.walk():
        section = next((a.tag for a in part.ancestors() if a.tag in ("thead", "tbody", "table")), "table")
        if part.tag == "th" and section == "thead":
            heads.append(strip(part.text()))
        elif part.tag == "tr" and section in ("tbody", "table"):
            rows.append(cells(part, "td"))
    return heads, rows


def table_text(table: Node) -> str:
    heads, rows = table_rows(table)
    return "\n".join([" ".join(heads), *[" ".join(row) for row in rows]])


def hidden(node: Node) -> bool:
    """Offline only attributes and inline styles can tell."""
    style = re.sub(r"\s", "", node.attrs.get("style", "").lower())
    return (
        "hidden" in node.attrs
        or "display:none" in style
        or "visibility:hidden" in style
        or "visibility:collapse" in style
        or re.search(r"opacity:0*(?:\.0*)?(?:;|$)", style) is not None
    )


def _pieces(root: Node, visible_only: bool) -> list[str]:
    out: list[str] = []
    todo: list[Node | str | None] = list(reversed(root.children))
    while todo:
        item = todo.pop()
        if item is None:
            out.append("\n")
        elif isinstance(item, str):
            text = strip(re.sub(" {2,}", " ", re.sub(r"[\r\n\t]+", " ", item)))
            if text:
                out.append(text)
        elif item.tag == "style" or (visible_only and (item.tag == "script" or hidden(item))):
            continue
        elif item.tag == "br":
            out.append("\n")
        elif item.tag == "table":
            out += ["\n", table_text(item), "\n"]
        elif item.tag in INLINE:
            todo.extend(reversed(item.children))
        else:
            out.append("\n")
            todo.append(None)
            todo.extend(reversed(item.children))
    return out


def block_text(containers: list[Node], visible_only: bool = True) -> str:
    """Text with a line per block; tables flattened; containers apart by a blank line."""
    texts = []
    for box in containers:
        if box.tag == "table":
            texts.append(table_text(box))
        else:
            pieces = _pieces(box, visible_only)
            if pieces:
                texts.append(" ".join(pieces))
    return strip("\n\n".join(texts))


def tidy(text: str) -> str:
    """Stored form of a block text."""
    text = re.sub(r"\s*[\r\n]+\s*", " <br> ", text)
    return strip(re.sub(" {2,}", " ", re.sub("\t+", " ", text)))


def joined_text(nodes: list[Node]) -> str:
    return " ".join(one_line(n.text()) for n in nodes)


def images(nodes: list[Node], page_url: str, container: str | None = None, caption: str | None = None) -> list[dict]:
    """http(s) pictures with the caption inside their nearest container; vector graphics left out."""
    out = []
    for node in nodes:
        src = node.attrs.get("src", "")
        if not src or re.match(r"(?i)(data|blob):", src):
            continue
        url = urljoin(page_url, src)
        if not re.match(r"(?i)https?:", url) or re.sub(r"[?#].*", "", url).endswith(".svg"):
            continue
        text = ""
        if container and caption:
            box = next((a for a in [node, *node.ancestors()] if Selector(container).matches(a)), None)
            found = Selector(caption).all(box) if box is not None else []
            text = strip(found[0].text()) if found else ""
        out.append({"url": url, "caption": text})
    return out


def apply_template(value: str, rule: dict | None) -> str:
    """First match of a pattern replaced by a template with ${n} groups."""
    if not rule or not rule.get("pattern"):
        return value
    def fill(match: re.Match) -> str:
        groups = match.groups()
        return re.sub(
            r"\$\{(\d+)\}",
            lambda g: (groups[int(g[1]) - 1] or "") if 0 < int(g[1]) <= len(groups) else "",
            rule.get("output") or "",
        )
    return re.sub(rule["pattern"], fill, value, count=1)


def attributes(nodes: list[Node], name: str, page_url: str, rule: dict | None = None) -> list[str]:
    values = [apply_template(n.attrs[name], rule) for n in nodes if n.attrs.get(name)]
    return [urljoin(page_url, v) for v in values]


def links(nodes: list[Node]) -> list[str]:
    """href of an anchor, or of the first anchor inside another element."""
    out = []
    for node in nodes:
        anchor = node if node.tag == "a" else next((n for n in node.walk() if n.tag == "a"), None)
        if anchor is not None and "href" in anchor.attrs:
            out.append(anchor.attrs["href"])
    return out


def own_text(nodes: list[Node]) -> str:
    return strip("".join(c for n in nodes for c in n.children if isinstance(c, str)))


# What an author or a date reads as when the page has none.
NO_AUTHOR = "작성자 미표기"
NO_DATE = "00000000"


def author(nodes: list[Node]) -> str:
    anchors = [strip(a.text()) for n in nodes for a in n.walk() if a.tag == "a"]
    return ", ".join(anchors) or own_text(nodes) or NO_AUTHOR


def written(nodes: list[Node], root: Node) -> str:
    """Raw date text; a class many article pages share is the fallback."""
    text = strip("".join(n.text() for n in nodes))
    if not text:
        meta = Selector("p[class='article-meta__publish-date']").all(root)
        text = strip(meta[0].text()) if meta else ""
    return text or NO_DATE


def content(nodes: list[Node]) -> str:
    return "".join(strip(n.text()) + "\n" for n in nodes)


# ---- cleaned html -----------------------------------------------------------

def _drop(node: Node) -> None:
    if node.parent is not None:
        node.parent.children = [c for c in node.parent.children if c is not node]


def _escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quote else text


def _inner_html(node: Node) -> str:
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(_escape(child))
        else:
            attrs = "".join(f' {k}="{_escape(v, True)}"' for k, v in child.attrs.items())
            out.append(f"<{child.tag}{attrs}>")
            if child.tag not in ("br", "hr", "img", "input", "link", "meta", "source", "embed"):
                out.append(_inner_html(child) + f"</{child.tag}>")
    return "".join(out)


def clean_html(root: Node, keep_media: bool, paragraph_chars: int | None = None) -> str:
    """The page body without chrome, consent banners, empty tags and long paragraphs."""
    for node in list(root.walk()):
        name = node.attrs.get("class", "") + "\n" + node.attrs.get("id", "")
        if node.tag in CHROME or any(word in name for word in CONSENT) or (not keep_media and node.tag in MEDIA):
            _drop(node)
    for node in list(root.walk()):
        if not any(isinstance(c, Node) for c in node.children) and not strip(node.text()):
            _drop(node)
    for node in list(root.walk()):
        node.attrs.pop("style", None)
        node.children = [c for c in node.children if isinstance(c, Node) or strip(c.replace("\xa0", ""))]
    for node in list(root.walk()):
        if node.tag in ("p", "div", "section", "article") and not strip(node.text()):
            if not any(n.tag in ("img", "iframe", "video") for n in node.walk()):
                _drop(node)
    for node in root.walk():
        if node.tag == "p":
            text = strip(node.text())
            if paragraph_chars is not None and len(text) > paragraph_chars:
                node.children = [text[:paragraph_chars] + " ..."]
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return strip(re.sub(r"[\r\n]", " ", re.sub(r"\s{2,}", " ", _inner_html(body))))
