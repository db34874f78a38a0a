"""Main-text extraction by tree scoring.

Every paragraph passes points (one, one per comma, one per hundred characters up to three) to its parent and half to its
grandparent; a container's points are discounted by its link density and moved by what its name says. The best container
is kept together with the siblings that score well; menus, notices, adverts, forms and comments are cut out of it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa

from pyspark.sql import DataFrame

from rankflow.llm.common import prepare

#: Attributes are matched possessively, so a page is read in linear time.
_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|!--|[!?/][^>]*+>)")
_LOOSE_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|!--|[!?/][^>]*+>)")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What is never text, page furniture by its element, and what belongs to a form.
_DROP = set("script style title textarea xmp iframe noembed noframes noscript template head nav footer aside form select input dialog menu".split())
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words of names: runs of lower-case letters or digits, and of capitals before them.
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Names of menus, headers, footers, sidebars, notices, adverts and forms; the last word of a name says what it is.
_BAD = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners consent cookie cookies disclaimer footer foot form forms gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination paywall popup related recommended recommendations share sharing shares sidebar sidebars signup skyscraper sponsor sponsored sponsors subscribe subscription".split()
)
#: Names of reader comments, wherever they stand in a name.
_COMMENTS = {"comment", "comments", "disqus", "respond", "replies"}
_GOOD = set("article articles body content entry main page post posts story text blog hentry prose".split())
_PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main", "body", "figcaption", "details", "h1", "h2", "h3", "h4", "h5", "h6"}
#: What may be called a header within an article: its head line.
_HEADINGS = {"header", "h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = _BLOCK - {"body", "html", "caption", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SAME = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


class Node:
    """An element; ``parts`` are its texts and child elements in order."""

    __slots__ = ("tag", "parent", "parts", "drop", "bias", "points", "inside")

    def __init__(self, tag, parent, drop=False, bias=0):
        self.tag, self.parent, self.parts, self.drop, self.bias, self.points = tag, parent, [], drop, bias, 0.0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside


def name_says(name: str) -> int:
    """1 if a class or id names the main text, -1 if it names what an article is not, else 0.

    The last word that is known decides: ``main-menu`` is a menu, ``post-body`` a body. Words that only place or number
    an element (``ad-slot-1``, ``sidebar_left``) are not known, so the word before them decides. A name with a word for
    reader comments is theirs.
    """
    words = [w.lower() for w in _NAMES.findall(name)]
    if _COMMENTS.intersection(words):
        return -1
    for k in range(len(words) - 1, -1, -1):
        if words[k] in _BAD:
            return -1
        if words[k] in _GOOD:  # the content of a sidebar is not the content of the page
            return -1 if _BAD.intersection(words[:k]) else 1
    return 0


def _judge(tag: str, attributes: str, inside_article: bool) -> tuple[bool, int]:
    """Whether the element is left out, and what its names say for it."""
    drop = tag in _DROP or (tag == "header" and not inside_article)
    bias = 25 if tag in ("article", "main") else 0
    if attributes.strip(" /\n\t"):
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                says = [name_says(name) for name in value.split()]
                bias += 25 * ((1 in says) - (-1 in says))
                if -1 in says and tag not in ("html", "body", "article", "main") and not (tag in _HEADINGS and inside_article):
                    drop = True
            elif key == "role" and value.lower() in _DROP_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                drop = drop or tag not in ("html", "body")
    return drop, bias


def parse(page: str) -> Node:
    """A forgiving tree of the page: unclosed elements end where their container does."""
    root = Node("html", None)
    at, pos, tag_re = root, 0, _TAG
    n, seen = len(page), set()
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            at.parts.append(page[pos:])
            break
        if lt > pos:
            at.parts.append(page[pos:lt])
        m = tag_re.match(page, lt)
        if m is None and tag_re is _TAG and (m := _LOOSE_TAG.match(page, lt)):
            tag_re = _LOOSE_TAG  # an unclosed quote: from here on quotes are not heeded
        if m is None:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] in "/!?"):
                break  # an unfinished tag ends the page
            at.parts.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", pos)
                pos = n if end < 0 else end + 3
            continue
        tag = m[2].lower()
        if m[1]:
            node = at if tag in seen else root
            while node is not root and node.tag != tag:
                if tag not in _BLOCK and node.tag in _BLOCK:
                    node = root  # a stray end of an inline element stops at its block
                    break
                node = node.parent
            if node is not root:
                at = node.parent
            continue
        if tag in _CLOSES_P:
            node = at
            while node is not root and node.tag != "p" and (node.tag not in _BLOCK):
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in _SAME:
            node, stops = at, _SAME[tag]
            like = {"td", "th"} if tag in ("td", "th") else {"dd", "dt"} if tag in ("dd", "dt") else {tag}
            while node is not root and node.tag not in like and node.tag not in stops:
                node = node.parent
            if node.tag in like:
                at = node.parent
        if tag in ("html", "body"):
            drop, bias = _judge(tag, m[3], False)
            if tag == "body" and at is not root:
                while at is not root and at.tag == "head":
                    at = at.parent
        elif tag == "br":
            at.parts.append(" ")
            continue
        else:
            drop, bias = _judge(tag, m[3], at.inside)
        if tag == "html":
            continue
        seen.add(tag)
        child = Node(tag, at, drop, bias)
        at.parts.append(child)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, pos)
            pos = n if end is None else end.start()
            child.drop = True
        if not (m[3].endswith("/") and tag in ("svg", "path", "use")):
            at = child
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of ``node`` in page order, white space as one space, without what is left out."""
    found: list[str] = []
    run: list[str] = []

    def flush():
        if run:
            raw = "".join(run)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            run.clear()
            if text:
                found.append(text)

    work: list = [node]
    while work:
        part = work.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif not part.drop:
            if part.tag in _BLOCK:
                flush()
                work.append(None)
            work.extend(reversed(part.parts))
    flush()
    return found


def _own(node: Node) -> tuple[str, int]:
    """Text of ``node`` without its blocks, and how many of its characters are in links."""
    out, links = [], 0
    work = [(p, False) for p in reversed(node.parts)]
    while work:
        part, linked = work.pop()
        if isinstance(part, str):
            out.append(part)
            links += len(part.strip()) if linked else 0
        elif not part.drop and part.tag not in _BLOCK:
            work.extend((p, linked or part.tag == "a") for p in reversed(part.parts))
    return " ".join("".join(out).split()), links


def main_text(page: str) -> str:
    """The article of ``page``: its blocks joined by line feeds; empty if there is none."""
    root = parse(page)
    nodes, length, linked, scored = [], {}, {}, []
    work = [root]
    while work:
        node = work.pop()
        if node.drop:
            continue
        nodes.append(node)
        work.extend(p for p in node.parts if isinstance(p, Node))
    for node in reversed(nodes):  # children come after their parents
        if node.tag in _BLOCK:
            text, links = _own(node)
            length[node] = length.get(node, 0) + len(text)
            linked[node] = linked.get(node, 0) + links
            if text and node.tag in _PARAGRAPH:
                points = 1 + text.count(",") + text.count("，") + text.count("、") + min(3, len(text) // 100)
                points *= 1 - min(1.0, links / len(text))
                parent = node if node.tag in ("div", "section", "article", "main", "body", "td") else node.parent
                while parent is not None and parent.tag not in _BLOCK and parent is not root:
                    parent = parent.parent
                for share in (1, 2):
                    if parent is not None:
                        if not parent.points:
                            scored.append(parent)
                        parent.points += points / share
                        parent = parent.parent
            up = node.parent
            while up is not None and up.tag not in _BLOCK and up is not root:
                up = up.parent
            if up is not None:
                length[up] = length.get(up, 0) + length[node]
                linked[up] = linked.get(up, 0) + linked[node]

    def score(node):
        density = min(1.0, linked.get(node, 0) / max(1, length.get(node, 0)))
        return (node.points + (node.bias if node.points else 0)) * (1 - density)

    if not scored:
        return "\n".join(blocks(root))
    best = max(dict.fromkeys(scored), key=score)
    # A part of an article is not the article: go up while the container is one, or holds others that score as well.
    node = best
    while node.parent is not None and node.parent is not root:
        node = node.parent
        if node.tag in ("article", "main") and not node.drop and score(node) > 0:
            best = node
    least = max(10.0, 0.2 * score(best))
    kept = []
    for sibling in best.parent.parts if best.parent is not None else [best]:
        if sibling is best:
            kept.append(sibling)
        elif isinstance(sibling, Node) and not sibling.drop:
            density = linked.get(sibling, 0) / max(1, length.get(sibling, 0))
            if sibling.points and score(sibling) >= least or sibling.tag == "p" and density < 0.25 and length.get(sibling, 0) > 80:
                kept.append(sibling)
    return "\n".join(t for k in kept for t in blocks(k))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text``, ``n_chars``; one row per row of ``pages``.

    A null or empty page has an empty text. Null ids and urls stay; repeated rows are repeated; an empty table gives an
    empty result; other columns are ignored, so clashing names do no harm. A ``br`` counts as white space. Of containers
    with equal points the one whose first paragraph comes last in the page is the best. Pages of any length are read in
    one pass.
    """
    prepare(pages.sparkSession)
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    schema = f"page_id {source.schema['page_id'].dataType.simpleString()}, url {source.schema['url'].dataType.simpleString()}, text string, n_chars bigint"

    def run(batches):
        for batch in batches:
            texts = [main_text(v.as_py() or "") for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, schema)
