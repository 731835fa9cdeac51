"""HTML main-text extraction by tag-path ratios (operator 6).

A page is cut into blocks, each with its root-to-leaf tag path. Per path the text length, the punctuation and the linked
text are summed; a path's ratio fuses length and punctuation and is smoothed with the sum over its parent path, so a
heading beside long paragraphs is carried by them. Paths from a share of the best on choose the content roots: the
article or main element around their blocks, else the container that their surroundings make likely. Every block beneath
a root is kept, whatever its own ratio. Regions that a page marks itself as menus, headers, footers, asides, notices,
adverts, forms, scripts or reader comments never count.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches

#: The rest of a tag: quotes count after an equals sign alone, as in browsers. Possessive, so it can't backtrack.
_REST = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|xmp|noframes)(?=[\s/>]){_REST}(?:>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"""
    rf"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_REST})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z]{_REST}\Z|[^<]+|<""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Za-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？；：]")
#: Elements by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("nav footer aside button select option input menu head object canvas audio video map".split())
_FORMS = frozenset("form fieldset dialog".split())
_NOISE = frozenset("ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices alert sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond discussion disqus share sharing social related recommended promo promotion sponsor sponsored newsletter subscribe subscription popup modal overlay toolbar pagination pager skip widget login signup search".split())
_NOISY_ARTICLE = frozenset("ad ads advert advertisement comment comments promo related recommended sponsored teaser".split())
_LAYOUT = frozenset("banner header menu menus modal nav navbar navigation overlay sidebar toolbar widget".split())
_COMMENTS = frozenset("comment comments commentlist respond discussion disqus".split())
_PLAIN = frozenset("area articles bar block body bottom box btn buttons container content count footer form global group header holder icon icons inner item items left link links list message module outer page panel post posts primary right secondary section site slot stories text title tools top unit wrap wrapper".split())
_COMMENTS = frozenset("comment comments commentlist respond discussion disqus".split())
_PLAIN = frozenset("area articles bar block body bottom box btn buttons container content count footer form global group header holder icon icons inner item items left link links list message module outer page panel post posts primary right secondary section site slot stories text title tools top unit wrap wrapper".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())}
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption ul ol dl table thead tbody tfoot figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RUNNING = ("p", "li", "dd", "td", "blockquote", "pre", *sorted(_HEADINGS))
_RUNNING = ("p", "li", "dd", "td", "blockquote", "pre", *sorted(_HEADINGS))
_SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _noise(name: str, attributes: str, inside_article: bool) -> str:
    """What speaks against an element: "drop" (its kind, its role or being hidden), or a mark to be weighed against its text:
    "comment", "mark" or "layout" (a name of class or id made of noise words and plain ones; a form is marked as well), "weak"
    (a noise word in a name that says something else, such as has-sidebar or related-work), or "" for nothing."""
    if name in _DROPPED or name == "header" and not inside_article:
        return "drop"
    why = "mark" if name in _FORMS else ""
    if not attributes or attributes.isspace():
        return why
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (values[0] or values[1] or values[2]).lower()
        if key in ("class", "id"):
            if name == "article":
                if any(x in _NOISY_ARTICLE or x.startswith("comment-") for x in value.split()):
                    return "mark"
            elif name not in ("html", "body", "main"):
                for token in value.split():
                    words = set(_WORD.findall(token))
                    found = (words & _NOISE) | (words & {"header"} if not inside_article else set())
                    if not found:
                        continue
                    strong = all(x in _NOISE or x in _PLAIN or x.isdigit() for x in words)
                    kind = "weak" if not strong else "comment" if found & _COMMENTS else "layout" if found <= _LAYOUT else "mark"
                    why = max(why, kind, key=("", "weak", "layout", "mark", "comment").index)
        elif key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return "drop"
    return why


class _Page:
    """Blocks of a page, and its elements as a tree: every step is linear in the page, however deep it nests.

    blocks: (path, element, text, linked code points) in page order. An element's number is larger than its parent's, and
    so is a path's; element 0 and path 0 are the page itself. names[path] is the last tag of a path, above[path] the path
    before it; inside[path] holds which of article, main and p are on it.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, int, str, int]] = []
        self.parent, self.path_of, self.mark = [0], [0], [""]
        self.names, self.above, self.inside = [""], [0], [frozenset()]
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)

    def _open(self, parent: int, name: str, mark: str) -> int:
        at = self.path_of[parent]
        path = self._paths.get((at, name))
        if path is None:
            path = self._paths[at, name] = len(self.names)
            self.names.append(name)
            self.above.append(at)
            self.inside.append(self.inside[at] | {name} if name in ("article", "main", "p") else self.inside[at])
        self.parent.append(parent)
        self.path_of.append(path)
        self.mark.append(mark)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        stack: list[str] = []
        elements = [0]  # the open elements but inline ones, and where they stand on the stack
        solid = [-1]
        where: dict[str, list[int]] = defaultdict(list)
        buffer: list[str] = []
        linked, dropped_at = 0, -1

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                if text:
                    self.blocks.append((self.path_of[elements[-1]], elements[-1], text, min(linked, len(text))))
            linked = 0

        def close(i: int) -> None:
            nonlocal dropped_at
            while len(stack) > i:
                where[stack.pop()].pop()
            while solid[-1] >= i:
                solid.pop()
                elements.pop()
            if dropped_at >= i:
                dropped_at = -1

        def push(name: str, attributes: str) -> str:
            """The element's mark. Inline ones can't be weighed, so a strong mark drops them outside of running text."""
            nonlocal dropped_at
            mark = _noise(name, attributes, bool(where["article"]))
            inline = name in _INLINE and mark not in ("", "weak") and not any(where[x] for x in _RUNNING)
            if dropped_at < 0 and (mark == "drop" or inline):
                dropped_at = len(stack)
            where[name].append(len(stack))
            stack.append(name)
            return mark

        for m in _TOKEN.finditer(html):
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                if dropped_at < 0:
                    text = unescape(raw)
                    buffer.append(text)
                    if where["a"]:
                        linked += len(text)
                continue
            name = m.group(3)
            if name is None:
                continue
            name = name.lower()
            last = where[name][-1] if where[name] else -1
            if name in _INLINE:
                if name == "br" or name == "img":
                    if dropped_at < 0:
                        buffer.append(" ")
                elif not m.group(2):
                    push(name, m.group(4))
                elif last > solid[-1]:
                    close(last)
                continue
            if dropped_at < 0:
                flush()
            if m.group(2):
                if last >= 0:
                    close(last)
                continue
            if name in _VOID or m.group(4).endswith("/") and name not in ("p", "div", "article", "section", "main"):
                continue
            if where["p"] and name in _CLOSES["p"]:
                close(where["p"][-1])
            elif last >= 0 and name in _SELF_CLOSING and not any(where[x] and where[x][-1] >= last for x in _SELF_CLOSING[name]):
                close(last)
            mark = push(name, m.group(4))
            solid.append(len(stack) - 1)
            elements.append(self._open(elements[-1], name, mark))
        if dropped_at < 0:
            flush()
        if any(self.mark):
            self._weigh()

    def _weigh(self) -> None:
        """Leave out the blocks of marked elements, but for those whose text speaks for them.

        A weak mark counts for elements of links mostly. What is marked as layout is a wrapper if an article or main element
        without a mark lies in it. Other marks (but comments) don't count for an element that holds over half of the page's
        unlinked text beside comments, unless the page has an article or main element elsewhere.
        """
        n = len(self.parent)
        text, core, comment = [[0, 0] for _ in range(n)], [0] * n, [False] * n
        for i in range(1, n):
            comment[i] = comment[self.parent[i]] or self.mark[i] == "comment"
            core[i] = int(not self.mark[i] and self.names[self.path_of[i]] in ("article", "main"))
        for _, element, block, linked in self.blocks:
            text[element][0] += len(block) - linked
            text[element][1] += linked
        total = sum(text[e][0] for e in range(n) if not comment[e])
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            text[up][0] += text[i][0]
            text[up][1] += text[i][1]
            core[up] += core[i]
        gone = [False]
        for i in range(1, n):
            mark, (plain, linked) = self.mark[i], text[i]
            noise = mark == "weak" and linked > plain or mark == "comment" or mark == "layout" and not core[i] or mark == "mark"
            if noise and mark in ("mark", "layout") and 2 * plain > total and core[i] == core[0]:
                noise = False
            gone.append(gone[self.parent[i]] or noise)
        self.blocks = [x for x in self.blocks if not gone[x[1]]]

    def _weigh(self) -> None:
        """Leave out the blocks of marked elements, but for those whose text speaks for them.

        A weak mark counts for elements of links mostly. What is marked as layout is a wrapper if an article or main element
        without a mark lies in it. Other marks (but comments) don't count for an element that holds over half of the page's
        unlinked text beside comments, unless the page has an article or main element elsewhere.
        """
        n = len(self.parent)
        text, core, comment = [[0, 0] for _ in range(n)], [0] * n, [False] * n
        for i in range(1, n):
            comment[i] = comment[self.parent[i]] or self.mark[i] == "comment"
            core[i] = int(not self.mark[i] and self.names[self.path_of[i]] in ("article", "main"))
        for _, element, block, linked in self.blocks:
            text[element][0] += len(block) - linked
            text[element][1] += linked
        total = sum(text[e][0] for e in range(n) if not comment[e])
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            text[up][0] += text[i][0]
            text[up][1] += text[i][1]
            core[up] += core[i]
        gone = [False]
        for i in range(1, n):
            mark, (plain, linked) = self.mark[i], text[i]
            noise = mark == "weak" and linked > plain or mark == "comment" or mark == "layout" and not core[i] or mark == "mark"
            if noise and mark in ("mark", "layout") and 2 * plain > total and core[i] == core[0]:
                noise = False
            gone.append(gone[self.parent[i]] or noise)
        self.blocks = [x for x in self.blocks if not gone[x[1]]]

    def roots(self, beneath: list[list[int]]) -> list[int]:
        """Of each element the one whose blocks count with its own; 0 for the whole page.

        That is the outermost article, else the outermost main element. Without either it is the block's container, and
        then each container around it as long as what that adds isn't mostly links; body only for a heading.
        """
        names, marked, out = [self.names[p] for p in self.path_of], {"article": [0], "main": [0]}, [0]
        for i in range(1, len(names)):
            up = self.parent[i]
            for name, held in marked.items():
                held.append(held[up] or (i if names[i] == name else 0))
            if names[i] in ("body", "html"):
                out.append(0)
            elif names[i] in _LEAVES:
                out.append(out[up] if up else 0)
            else:
                added = [x - y for x, y in zip(beneath[up], beneath[i], strict=True)]
                stays = not up or added[1] > added[0] or names[up] == "html" or names[up] == "body" and not added[2]
                out.append(i if stays else out[up])
        return [a or m or x for a, m, x in zip(marked["article"], marked["main"], out, strict=True)]


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, linked code points) of each block outside marked regions, in page order."""
    page, out = _Page(html), []
    for path, _, text, linked in page.blocks:
        tags = []
        while path:
            tags.append(page.names[path])
            path = page.above[path]
        out.append((tuple(reversed(tags)), text, linked))
    return out


def extract(html: str, threshold: float = 0.25, smooth: float = 0.5) -> str:
    """Main text: all blocks beneath the content roots in page order, joined by one newline.

    Where the whole page is the root, blocks of links alone outside paragraphs are left out, as menus without marks are.
    """
    page = _Page(html)
    length, marks = ([[0] * len(page.names) for _ in range(2)] for _ in range(2))  # of a path, and of all paths one tag longer
    beneath = [[0, 0, 0] for _ in page.parent]  # unlinked and linked code points, headings
    for path, element, text, linked in page.blocks:
        n, p = len(text) - linked, len(_PUNCTUATION.findall(text)) if linked < len(text) else 0
        for i, at in enumerate((path, page.above[path])):
            length[i][at] += n
            marks[i][at] += p
        held = beneath[element]
        held[0] += n
        held[1] += linked
        held[2] += page.names[path] in _HEADINGS
    for i in range(len(beneath) - 1, 0, -1):
        up = beneath[page.parent[i]]
        for j, x in enumerate(beneath[i]):
            up[j] += x

    def ratio(i: int, at: int) -> float:
        inside = page.inside[at]
        return log1p(length[i][at]) * (1 + log1p(marks[i][at])) * (3 if "article" in inside else 2 if "main" in inside else 1)

    score = {path: (1 - smooth) * ratio(0, path) + smooth * ratio(1, page.above[path]) for path in {x[0] for x in page.blocks}}
    best, root_of = max(score.values(), default=0), page.roots(beneath)
    content = [linked < len(text) or not page.inside[path].isdisjoint(("p", "article")) for path, _, text, linked in page.blocks]
    roots = {root_of[x[1]] for x, yes in zip(page.blocks, content, strict=True) if yes and score[x[0]] >= threshold * best}
    kept = [False]
    for i in range(1, len(page.parent)):
        kept.append(i in roots or kept[page.parent[i]])
    return "\n".join(x[2] for x, yes in zip(page.blocks, content, strict=True) if yes and 0 in roots or kept[x[1]])


def extract_pages(pages: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars.

    ``pages`` needs page_id, url and html; other columns are ignored, whatever their names. A null html counts as empty;
    broken or cut-off markup is read as far as it goes. Very long and deeply nested pages are read whole, in linear time.
    Paths of equal ratio count alike. Repeated rows each get a row; an empty table gives an empty result.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py() or "", threshold) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
