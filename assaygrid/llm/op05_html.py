"""Main text of pages by a site style tree (operator 5).

Each page becomes a tree of elements; an element's style is its tag and class names, its place the styles from the
body down.  The trees of one host are merged: for every place the pages of the host are counted, with how their text
there is spread (equal pages count once).  Content importance is the entropy of that spread over the log of the
pages, shrunk to a neutral value while pages are few, times the part of the text outside links.  Presentation
importance is 0 in navigation, footers, forms, adverts and the like, and beside an article; 1 in an article and
around it, a form or a part like ``search-page`` too; elsewhere the content decides.  A place's importance is the mean over its pages.  Branches of low
importance are taken out of every page of the host; what is left is written block by block in page order.

Null or empty html gives the empty text.  Pages with a null url form one host.  Repeated rows are answered row by
row; null page_ids are kept.  Only page_id, url and html are read.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import slices, table
from assaygrid.session import cut_lineage

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S)
CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button", "head"}
RAW_TEXT = {"script", "style", "textarea", "title"}  # their content holds no tags
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TEXT}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody
td tfoot th thead tr ul""".split())
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog"}
INSIDE = {"article", "main"}
#: Words of class names, ids and roles of parts that are not the article.
NOT_TEXT = re.compile(
    r"""^(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer\w*|cookie\w*|consent|
    notice\w*|alert\w*|popup|modal|overlay|newsletter|subscribe|signup|login|share\w*|social\w*|related\w*|recommend\w*|comment\w*|
    replies|reply|respond|disqus\w*|masthead|toolbar|pagination|pager|search\w*|widget\w*|copyright|complementary|contentinfo|navigation)$""",
    re.I | re.X,
)
#: Names that tell a state of the page (has-sidebar), not a part of it.
STATE = re.compile(r"^(?:has|have|no|not|with|without)[-_]|[-_](?:enabled|disabled)$", re.I)
#: Words that a compound name may have for the layout around the article too: such a part can hold it.
LAYOUT = re.compile(r"^(?:banner|nav|menu|sidebar|side|footer|masthead|toolbar|search|widget|modal|overlay|alert|notice)", re.I)
#: Whole names of an article that is none.
NO_ARTICLE = re.compile(r"^(?:(?:comment|reply|replies|respond|disqus)(?:[-_](?:body|content|item|text|\d+))*|ads?|advert\w*|sponsor\w*|promo|related|recommended)$", re.I)
#: A start tag of the key closes open elements of the value, up to the nearest of the last.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NEUTRAL, PRIOR_PAGES, LEAST = 0.5, 4.0, 0.35


class Page:
    """Blocks of a page in order: (places from the top down with their kinds, text, characters inside links).

    Kind of a place: -1 in a part that is no text, -2 or -3 (a form) in one that may hold an article, 1 in an article,
    else 0.  Where forms hold more than half of the text, they are no mark of a part: one form is around the page.
    """

    def __init__(self, html: str):
        self.forms = True
        self.read(html)
        sizes = [(len(text), places and places[-1][1] == -3) for places, text, _ in self.blocks]
        if 2 * sum(n for n, form in sizes if form) > sum(n for n, _ in sizes):
            self.forms = False
            self.read(html)

    def read(self, html: str) -> None:
        self.blocks: list[tuple[tuple[tuple[str, int], ...], str, int]] = []
        self.stack: list[tuple[str, str, int]] = []  # tag, place, kind; 2: hidden
        self.text: list[str] = []
        self.linked = 0
        at = 0
        while m := TOKEN.match(html, at):
            at = m.end()
            tag = m[2]
            if tag is None:
                s = m[0]
                if not s.startswith(("<!", "<?")):
                    self.data(s)
                continue
            tag = tag.lower()
            if m[1]:
                self.close(tag)
            else:
                self.open(tag, m[3])
                if tag in RAW_TEXT:  # up to the literal end tag, which is a token again
                    end = RAW_END[tag].search(html, at)
                    at = end.start() if end else len(html)
        self.flush()

    def data(self, s: str) -> None:
        if self.stack and self.stack[-1][2] == 2:
            return
        self.text.append(s)
        if any(t == "a" for t, _, _ in self.stack):
            self.linked += len(s)

    def flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            if text:
                self.blocks.append((tuple((p, k) for t, p, k in self.stack if t in BLOCKS), text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if any(t == "p" for t, _, _ in self.stack):  # a block ends an open paragraph
                self.close("p")
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in stop:
                    break
                if self.stack[i][0] in own:
                    del self.stack[i:]
                    break
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS:
            return
        words: list[str] = []
        marks: list[str] = []
        for name, *value in CLASS.findall(attrs) if attrs else ():
            names = "".join(value).lower().split()
            marks += names
            if name.lower() == "class":
                words += [re.sub(r"\d+", "0", w) for w in names]
        style = ".".join([tag, *sorted(words)])
        place = f"{self.stack[-1][1]}/{style}" if self.stack else style
        above = self.stack[-1][2] if self.stack else 0
        if above in (2, -1):
            kind = above
        elif tag in RAW:
            kind = 2
        else:
            kind = self.rejected(tag, marks, above) or (1 if tag in INSIDE else above)
            if above < 0 and tag not in INSIDE and kind != -1:
                kind = above
        self.stack.append((tag, place, kind))

    def rejected(self, tag: str, marks: list[str], above: int) -> int:
        """Kind of an element that is marked as no text, else 0."""
        if tag in ("html", "body", "main"):
            return 0
        if tag == "article":
            return -1 if any(NO_ARTICLE.match(w) for w in marks) else 0
        if tag in OUTSIDE and tag != "form" or tag == "header" and above != 1:
            return -1
        names = [w for w in marks if not STATE.search(w)]
        parts = [p for w in names for p in re.split(r"[-_]+", w) if NOT_TEXT.match(p)]
        if any(NOT_TEXT.match(w) for w in names) or not all(LAYOUT.match(p) for p in parts):
            return -1
        return -2 if parts else -3 if tag == "form" and self.forms else 0

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in INSIDE and tag not in {"body", "html"} | INSIDE:
                return


def host_of():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def place_rows(pages: DataFrame) -> DataFrame:
    """(host, page, place, content, chars, linked, shown): each place of each page with hashes of the page and of its text there.

    shown: presentation importance, null where the content decides.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                out = ([], [], [], [], [], [], [])
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    blocks = Page(html or "").blocks
                    around = {p for places, *_ in blocks if places and places[-1][1] == 1 for p, _ in places}
                    at: dict[str, list] = {}
                    for places, text, linked in blocks:
                        h = zlib.crc32(text.encode()) | len(text) << 32
                        for p, kind in places:
                            shown = 1.0 if p in around and kind != -1 else 0.0 if kind < 0 or around else None
                            x = at.setdefault(p, [0, 0, 0, shown])
                            x[0], x[1], x[2] = (x[0] * 1000003 + h) % 2**61, x[1] + len(text), x[2] + linked
                    whole = zlib.crc32((html or "").encode()) | (len(html or "") << 32)
                    for p, x in at.items():
                        for c, v in zip(out, (host, whole, p, *x)):
                            c.append(v)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                names = ["host", "page", "place", "content", "chars", "linked", "shown"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return pages.select("host", "html").mapInArrow(
        run, "host string, page bigint, place string, content bigint, chars bigint, linked bigint, shown double"
    )


def place_importance(pages: DataFrame) -> DataFrame:
    """(host, place, pages, entropy, importance) of the merged trees."""
    own = place_rows(pages).distinct()  # equal pages count once
    spread = own.groupBy("host", "place", "content").agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.coalesce(F.sum("shown"), F.lit(0.0)).alias("shown"), F.count("shown").alias("told"),
    )
    at = spread.groupBy("host", "place").agg(
        F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("clogc"),
        *[F.sum(x).alias(x) for x in ("chars", "linked", "shown", "told")],
    )
    entropy = F.when(F.col("pages") > 1, 1 - F.try_divide("clogc", F.col("pages") * F.log("pages"))).otherwise(NEUTRAL)
    content = (F.col("pages") * F.col("entropy") + PRIOR_PAGES * NEUTRAL) / (F.col("pages") + PRIOR_PAGES)
    content = content * (1 - F.coalesce(F.try_divide("linked", "chars"), F.lit(0.0)))
    importance = (F.col("shown") + (F.col("pages") - F.col("told")) * content) / F.col("pages")
    return at.withColumn("entropy", entropy).select("host", "place", "pages", "entropy", importance.alias("importance"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_removed) for every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html", host_of().alias("host"))
    low = place_importance(rows).filter(F.col("importance") < LEAST)
    low = cut_lineage(low.groupBy("host").agg(F.collect_list("place").alias("places")))
    if low.select(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= 50_000:  # a checked size; a longer list is joined by host
        low = F.broadcast(low)
    rows = rows.join(low, "host", "left").select("page_id", "url", "html", "places")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts, blocks, removed = [], [], []
                for html, low_ in zip(part.column("html").to_pylist(), part.column("places").to_pylist()):
                    page, low_ = Page(html or ""), set(low_ or ())
                    kept = [t for places, t, _ in page.blocks if not any(p in low_ for p, _ in places)]
                    texts.append("\n\n".join(kept))
                    blocks.append(len(kept))
                    removed.append(len(page.blocks) - len(kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(blocks, pa.int64()), pa.array(removed, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_removed"],
                )

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_removed bigint")


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
