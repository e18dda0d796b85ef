"""Main text of HTML pages by host consensus.

1. Every page is read once into a tree without boilerplate, and its containers are scored by the text in all of their
   subtree: characters less twice those inside links. The page's own choice is the lowest container that holds most of the
   page's text (``MOST``), but never less than a whole article, or a whole main part without one. It counts in full; a container
   further out counts half for each step, and any other half of its text.
2. Containers vote for their path, the tags from the body down with their classes, digits generalised. Votes are shares of
   the page's best score, so long pages don't outvote short ones. Spark adds them up for each host.
3. Every page is read again with the winning path of its host; the outermost containers on that path give the text. A page
   without such a container, or without text in it, uses its own choice.

Left out with all they contain: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts
and reader comments, known by tag or by the words of class, id and role. A compound name such as ``layout-sidebar-right`` can
also belong to a wrapper: its element stays if it holds an article or main part, or more than half of the page's text. Character
references are decoded. White space inside a block becomes one space; blocks are trimmed and joined in page order by one space.

Null or empty html gives empty text; a null url is a host of its own. Repeated pages are extracted each; text is never cut.
An empty table gives no rows, and further columns aren't read. Ties between paths go to the first in alphabetical order.
"""

from __future__ import annotations

import html as markup
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "xmp")}

# Tags and name words of the HTML vocabulary and of common page templates.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike"
             " strong sub sup time tt u var wbr".split())
DROPPED = set("nav header footer aside form script style noscript template iframe object svg button select textarea input dialog"
              " menu title canvas audio video map xmp".split())
NEVER = {"html", "body", "main", "article"}
NAMES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus"
            " breadcrumb breadcrumbs header masthead topbar footer bottombar colophon copyright sidebar sidebars aside widget widgets"
            " notice notices cookie cookies consent gdpr banner alert popup modal overlay toast comment comments disqus respond replies"
            " newsletter subscribe subscription signup login search share sharing social related recommended recommendations"
            " pagination pager skip".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEGATED = {"no", "has", "with", "without", "is"}
#: Names of parts that are never wrappers of the article.
ALWAYS = set("ad ads adv advert adverts advertisement advertising comment comments disqus respond replies footer nav navbar navigation menu menus".split())
#: Share of a page's text that its own choice holds at least.
MOST = 0.6
KEEP, DROP, MAYBE = 0, 1, 2
#: An opening tag closes an open element of these kinds, unless the stop lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BLANK_WORD = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")


class Page:
    """Containers and text of a page without its boilerplate."""

    def __init__(self, source: str):
        self.parents, self.paths, self.text = [-1], [""], []  # text: (container, text or None for a break, inside a link)
        self.tags, self.doubtful = [""], []  # doubtful: containers with a compound name of boilerplate
        self.stack = [("", 0, False)]  # tag, container, whether it is left out
        self._read(source)
        if self.doubtful:
            self._decide()

    def _read(self, source: str) -> None:
        at, links = 0, 0
        for m in iter(lambda: TAG.search(source, at), None):
            if m.start() > at:
                self._say(source[at:m.start()], links)
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                links -= tag == "a" and links > 0
                self._close(tag)
                continue
            links += tag == "a"
            if tag in RAW:
                end = RAW[tag].search(source, at)
                at = end.end() if end else len(source)
                if tag not in INLINE:
                    self._break()
                continue
            self._open(tag, m[3])
        if at < len(source):
            self._say(source[at:], links)

    def _say(self, text: str, links: int) -> None:
        if not self.stack[-1][2]:
            self.text.append((self.stack[-1][1], text, links > 0))

    def _break(self) -> None:
        if not self.stack[-1][2]:
            self.text.append((self.stack[-1][1], None, False))

    def _open(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if not inline:
            self._break()
            if tag != "br":
                self._end_paragraph()
            if tag in CLOSES:
                self._imply(*CLOSES[tag])
        if tag in VOID:
            return
        names = dict((m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)) if attributes else {}
        box = not inline and tag not in ("p", "html")
        named = KEEP if tag in NEVER or not names else self._boilerplate(names)
        out = self.stack[-1][2] or tag in DROPPED or named == DROP or named == MAYBE and not box
        node = self.stack[-1][1]
        if box and not out:
            classes = DIGITS.sub("#", ".".join(sorted(names.get("class", "").lower().split())))
            step = f"{tag}.{classes}" if classes else tag
            self.parents.append(node)
            self.paths.append(f"{self.paths[node]}>{step}" if self.paths[node] else step)
            self.tags.append(tag)
            node = len(self.paths) - 1
            if named == MAYBE:
                self.doubtful.append(node)
        self.stack.append((tag, node, out))

    @staticmethod
    def _boilerplate(names: dict[str, str]) -> int:
        if "hidden" in names or names.get("aria-hidden") == "true" or names.get("role", "").lower() in ROLES:
            return DROP
        if "display:none" in names.get("style", "").replace(" ", "").lower():
            return DROP
        found = KEEP
        for value in (names.get("class", ""), names.get("id", "")):
            for name in value.split():
                words = [w for w in BLANK_WORD.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
                hits = [w for i, w in enumerate(words) if w in NAMES and not (i and words[i - 1] in NEGATED)]
                if hits:
                    if len(hits) == len(words) or not ALWAYS.isdisjoint(hits):
                        return DROP
                    found = MAYBE
        return found

    def _decide(self) -> None:
        """Leave out the doubtful containers that don't wrap the article."""
        sums, semantic = self.sums(), [t in ("article", "main") for t in self.tags]
        for i in range(len(self.tags) - 1, 0, -1):  # children come later
            semantic[self.parents[i]] |= semantic[i]
        gone = [False] * len(self.tags)
        doubtful = set(self.doubtful)
        for i in range(1, len(self.tags)):
            gone[i] = gone[self.parents[i]] or i in doubtful and not semantic[i] and 2 * sums[i] <= sums[0]
        self.text = [(n, t, link) if not gone[n] else (0, None, False) for n, t, link in self.text]

    def _end_paragraph(self) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag == "p":
                del self.stack[k:]
                return
            if tag not in INLINE:
                return

    def _imply(self, ends: set[str], stops: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in stops:
                return
            if tag in ends:
                del self.stack[k:]
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._break()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
            if tag in INLINE and self.stack[k][0] not in INLINE and self.stack[k][0] != "p":
                break
        if tag not in INLINE:
            self._break()

    def sums(self) -> list[int]:
        """Characters less twice those inside links, of all blocks below each container."""
        out, plain, linked, last = [0] * len(self.paths), 0, 0, 0

        def block():
            out[last] += max(0, plain - 2 * linked)

        for node, text, link in self.text:
            if text is None or node != last:
                block()
                plain = linked = 0
            last = node
            if text is not None:
                n = len(" ".join(text.split()))
                plain, linked = plain + n, linked + n * link
        block()
        for i in range(len(out) - 1, 0, -1):  # children come later
            out[self.parents[i]] += out[i]
        return out

    def choice(self, sums: list[int]) -> int:
        """The lowest container with most of the page's text; an article is not opened, a main part only for an article."""
        large = [i for i, n in enumerate(sums) if n >= MOST * sums[0] > 0]  # a chain, as two of them can't be side by side
        for tag in ("article", "main"):
            whole = [i for i in large if self.tags[i] == tag]
            if whole:
                return whole[0]
        return large[-1] if large else 0

    def best(self) -> tuple[int, list[int]]:
        """The page's own choice, and the score of every container in units of 1/1024 of a character."""
        sums = self.sums()
        top = self.choice(sums)
        out = [512 * n for n in sums]
        at, score = top, 1024 * sums[top]
        while at >= 0:
            out[at], at, score = score, self.parents[at], score // 2
        return top, out

    def votes(self) -> dict[str, int]:
        """Thousandths of the page's best score that the containers on a path reach, best one counted."""
        top, scores = self.best()
        out: dict[str, int] = {}
        for path, score in zip(self.paths, scores):
            if score and scores[top]:
                out[path] = max(out.get(path, 0), 1000 * score // scores[top])
        return out

    def main(self, path: str | None) -> str:
        """Text of the containers on a path, or of the page's own choice if there is none or it has no text."""
        chosen = {i for i, p in enumerate(self.paths) if p == path}
        return (self._text(chosen) if chosen else "") or self._text({self.best()[0]})

    def _text(self, chosen: set[int]) -> str:
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):  # parents come first
            inside[i] = i in chosen or parent >= 0 and inside[parent]
        parts = [" " if text is None else text for node, text, _ in self.text if text is None or inside[node]]
        return " ".join(markup.unescape("".join(parts)).split())


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with the most votes on each host."""

    def vote(batches):
        for batch in batches:
            rows = [(h, p, v) for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if source
                    for p, v in Page(source).votes().items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))],
                                                 names=["host", "path", "vote"])

    votes = pages.select(host(pages[url]).alias("host"), pages[html].alias("html")).mapInArrow(vote, "host string, path string, vote bigint")
    sums = votes.groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct((-F.col("votes")).alias("v"), F.col("path"))).alias("path"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, path) of every page; ``path`` is the winning path of its host."""
    paths = stored(winning_paths(pages, url, html), "paths").withColumnRenamed("host", "__host")
    rows = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[html].alias("html"), host(pages[url]).alias("__h"))
    rows = rows.join(paths, F.col("__h") == F.col("__host"), "left").select("key", "url", "html", "path")

    def extract(batches):
        for b in batches:
            texts = [Page(source).main(path) if source else "" for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), b.column(3)],
                names=["key", "url", "text", "n_chars", "path"])

    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(extract, f"key {kind}, url string, text string, n_chars bigint, path string").withColumnRenamed("key", key)
