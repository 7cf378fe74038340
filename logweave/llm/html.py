"""Main text of web pages by wrapper induction.

A page's blocks of text hang on a tree of slots: nested block elements, named
by tag and class, where equal siblings form one repeating slot.  A host has a
reference page for each of its most frequent layouts, and every page is aligned
with the one it fits best by simple tree matching.  A text that most aligned
pages hold in the same slot is template; what varies is content.  Pages of equal
content count once, so copies are no evidence.  Content inside elements that declare another purpose (menus,
adverts, forms, comments and the like) is left out, and where a page marks its
article, only that counts.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut, told

#: Elements of HTML by their role in the flow of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search "
    "section select summary table tbody td template tfoot th thead tr ul".split())
#: Elements and roles that are never the article.
APART = frozenset("aside button dialog footer form head menu nav noscript object search select svg template".split())
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
                        "search status toolbar".split())
#: What class and id words call such parts.
APART_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification "
    "overlay pagination paywall popup promo promoted promotion related replies respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: An opening tag ends these open elements, up to the bounds.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
          "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
          "tbody": ("tr td th thead tbody", "table"), "thead": ("tr td th thead tbody", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+>|[^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\"[^\"]*\"|'[^']*'")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_WORD = re.compile(r"[a-z]+")
#: Words by which a name tells of a state or of what an element has,
#: at its start or end, and of what only some names of a part go on with.
STATES_BEFORE = frozenset("can has have is js no non not show shows supports with without".split())
STATES_AFTER = frozenset("active closed collapsed disabled enabled expanded hidden lazy off on open opened shown toggled visible".split())
GOES_ON = {"related": frozenset("articles content items links list news pages posts products stories topics".split()),
           "skip": frozenset("link links nav navigation to".split()), "search": frozenset(
               "area bar box button field form input overlay panel widget".split())}


@lru_cache(maxsize=65536)
def names_part_apart(names: str) -> bool:
    """Whether a class or id value names an element that is never the article.  Each
    name is read whole: ``site-footer`` is a footer, ``has-sidebar`` and ``menu-open`` are
    an element with a sidebar and one in some state, ``related-work`` no list of links."""
    for name in names.split():
        words = _WORD.findall(name)
        if not words or words[0] in STATES_BEFORE or len(words) > 1 and words[-1] in STATES_AFTER:
            continue
        for k, word in enumerate(words):
            if word in APART_WORDS and (k + 1 == len(words) or word not in GOES_ON or words[k + 1] in GOES_ON[word]):
                return True
    return False
DEPTH = 64
LIMIT = 250_000


class Page:
    """Slots (label, parent) in order of appearance, and blocks (slot, text, apart, main)."""

    def __init__(self, html: str | None):
        self.labels, self.parents, self.blocks = ["#"], [-1], []
        self._slots: dict[tuple[int, str], int] = {}
        # Open elements: tag, slot, block element, apart, main, depth.
        self._open = [("#", 0, True, False, False, 0)]
        self._text: list[str] = []
        self._read(html or "")
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            _, slot, _, apart, main, _ = next(e for e in reversed(self._open) if e[2])
            self.blocks.append((slot, text, apart, main))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            self._words(html[at:m.start() if m else end])
            if not m:
                break
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                else:
                    self._start(tag, m[3])
                    if tag in SKIPPED and not m[3].endswith("/>"):
                        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                        at = close.end() if close else end
                        self._close(tag)

    def _words(self, text: str) -> None:
        if text:
            top, block = self._open[-1], next(e for e in reversed(self._open) if e[2])
            if not top[3] or block[3]:  # an inline part apart is cut out of its block
                self._text.append(unescape(text) if "&" in text else text)

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text.append(" ")
        block = tag in BLOCK
        if block:
            self._flush()
            ends, bounds = CLOSES.get(tag, (frozenset(), frozenset()))
            for k in range(len(self._open) - 1, 0, -1):
                name = self._open[k][0]
                if name == "p" or name in ends:
                    del self._open[k:]
                elif name in bounds or name not in ends and self._open[k][2] and not ends:
                    break
        if tag in VOID:
            return
        label, words, hide, role = tag, "", False, ""
        if attrs and ("=" in attrs or "hidden" in attrs):
            for name, value in _ATTR.findall(attrs):
                name = name.lower()
                if name not in _READ:
                    continue
                value = value.strip("\"'").lower()
                if name == "class":
                    label = f"{tag}.{re.sub('[0-9]+', '0', ' '.join(value.split()))}"
                if name in ("class", "id"):
                    words += f" {value}"
                elif name == "role":
                    role = value
                elif name == "hidden" or value == "true":
                    hide = True
        _, slot, _, apart, main, depth = self._open[-1]
        if not apart:
            apart = tag in APART or hide or role in APART_ROLES or tag == "header" and not main \
                or bool(words) and tag not in ("html", "body", "article", "main") \
                and names_part_apart(words)
        main = main or tag in ("article", "main") or role in ("main", "article")
        if block and depth < DEPTH:
            key = (slot, label)
            if key not in self._slots:
                self._slots[key] = len(self.labels)
                self.labels.append(label)
                self.parents.append(slot)
            slot, depth = self._slots[key], depth + 1
        self._open.append((tag, slot, block, apart, main, depth))

    def _close(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                if self._open[k][2]:
                    self._flush()
                    del self._open[k:]
                else:
                    del self._open[k]
                return
        if tag in BLOCK:
            self._flush()


def children(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for k, p in enumerate(parents):
        if p >= 0:
            out[p].append(k)
    return out


def match(labels_a, kids_a, labels_b, kids_b, a: int = 0, b: int = 0) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size and pairs of the largest order-keeping alignment
    of two trees in which matched nodes have matched parents."""
    if labels_a[a] != labels_b[b]:
        return 0, []
    x, y = kids_a[a], kids_b[b]
    if not x or not y:
        return 1, [(a, b)]
    if len(x) * len(y) > LIMIT:
        # Lists too long to weigh all orders: labels are unique among siblings, match by them.
        by = {labels_b[j]: j for j in y}
        parts = [match(labels_a, kids_a, labels_b, kids_b, i, by[labels_a[i]]) for i in x if labels_a[i] in by]
        return 1 + sum(p[0] for p in parts), [(a, b)] + [q for p in parts for q in p[1]]
    best = [[0] * (len(y) + 1)]
    pairs = {}
    for i, s in enumerate(x):
        row, above = [0], best[-1]
        for j, t in enumerate(y):
            most = max(above[j + 1], row[j])
            if labels_a[s] == labels_b[t]:
                pairs[i, j] = match(labels_a, kids_a, labels_b, kids_b, s, t)
                most = max(most, above[j] + pairs[i, j][0])
            row.append(most)
        best.append(row)
    out, i, j = [(a, b)], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out += pairs[i, j][1]
    return 1 + best[-1][-1], out


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2 ** 63


class Wrapper:
    """A host's reference slots, their texts' hashes, and which of them are template."""

    def __init__(self, tree: str, template=()):
        self.labels, parents, texts = json.loads(tree)
        self.kids = children(parents)
        self.texts = {int(k): set(v) for k, v in texts.items()}
        self.template = set(template)  # (slot, text hash)

    @staticmethod
    def tree(html: str | None) -> str:
        page = Page(html)
        texts: dict[int, list[int]] = {}
        for slot, text, _, _ in page.blocks:
            texts.setdefault(slot, []).append(text_hash(text))
        return json.dumps([page.labels, page.parents, {k: sorted(set(v)) for k, v in texts.items()}])

    def align(self, page: Page) -> dict[int, int]:
        """Reference slot of each aligned slot of the page."""
        pairs = match(self.labels, self.kids, page.labels, children(page.parents))[1]
        return {b: a for a, b in pairs}

    @staticmethod
    def nearest(wrappers: list["Wrapper"], page: Page) -> int:
        """The wrapper that most of the page and of the reference aligns with (the first of equals)."""
        if len(wrappers) == 1:
            return 0
        kids = children(page.parents)
        fit = [2 * match(w.labels, w.kids, page.labels, kids)[0] / (len(w.labels) + len(page.labels))
               for w in wrappers]
        return fit.index(max(fit))

    def evidence(self, page: Page) -> set[tuple[int, int]]:
        """(reference slot, text hash) that the page shares, and (slot, 0) for each slot it fills."""
        at, out = self.align(page), set()
        for slot, text, _, _ in page.blocks:
            ref = at.get(slot)
            if ref is not None:
                out.add((ref, 0))
                h = text_hash(text)
                if h in self.texts.get(ref, ()):
                    out.add((ref, h))
        return out

    def extract(self, page: Page) -> str:
        at = self.align(page) if self.template else {}
        content = [(main, text) for slot, text, apart, main in page.blocks
                   if not apart and not (slot in at and (at[slot], text_hash(text)) in self.template)]
        marked = any(main for main, _ in content)
        return "\n".join(text for main, text in content if main or not marked)


def layout(page: Page) -> int:
    """Hash of the slots down to the third level that hold no other purpose."""
    keep = set()
    for slot, _, apart, _ in page.blocks:
        path = []
        while slot > 0 and not apart:
            path.append(page.labels[slot])
            slot = page.parents[slot]
        keep.add(">".join(reversed(path[-3:])))
    return text_hash("\n".join(sorted(keep)))


def content(page: Page) -> int:
    """Hash of the content as it is without a template: equal for copies."""
    blocks = [(main, text) for _, text, apart, main in page.blocks if not apart]
    marked = any(main for main, _ in blocks)
    return text_hash("\n".join(text for main, text in blocks if main or not marked))


def host_of(url: Column) -> Column:
    """Host of a URL; empty for null or without ``://``."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def _beside(pages: DataFrame, by_host: DataFrame, size: Column, limit: int) -> DataFrame:
    """Pages with their host's row: sent to every task if all rows together hold
    at most ``limit`` bytes, else by a join that adaptive execution splits on hot hosts."""
    total = by_host.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return pages.join(F.broadcast(by_host) if total <= limit else by_host, "host", "left")


def _length(col: str) -> Column:
    return F.aggregate(col, F.lit(0), lambda n, t: n + F.length(t))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              least_pages: int = 5, least_share: float = 0.7, references: int = 4, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Rows (id, url, text, n_chars), one per input row.

    The wrappers of a host are induced from all its pages.  Its up to ``references``
    layouts with most pages give a reference page each (the one whose URL and id
    hash lowest; pages without text are none).  Every page is aligned with the
    reference it fits best, and a text is template where at least ``least_share``
    of at least ``least_pages`` other pages that fill the slot hold it; pages of
    equal content count as one.  Null html has the empty text; pages
    without a host share one wrapper; repeated rows stay repeated; an empty
    table gives no rows; other columns are ignored.  Slots nested deeper than
    64 blocks count as part of the 64th.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"),
                        F.xxhash64(url_col, id_col).alias("pick"))

    def shapes(batches):
        for b in batches:
            pages = [Page(h) for h in b["html"]]
            yield pd.DataFrame({"host": b["host"], "pick": b["pick"],
                                "layout": [layout(p) if p.blocks else None for p in pages]}).dropna().astype(
                                    {"pick": "int64", "layout": "int64"})

    def trees(batches):
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "layout": b["layout"], "tree": [Wrapper.tree(h) for h in b["html"]]})

    # Pages without html hold no text: they need no look.
    full = rows.where(F.length(F.trim("html")) > 0)
    kinds = full.select("host", "pick", "html").mapInPandas(shapes, "host string, pick long, layout long") \
        .groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("pick").alias("pick"))
    # At most ``references`` of a host's layouts stay, by a bounded heap in each partition.
    chosen = kinds.withColumn("rank", F.row_number().over(
        Window.partitionBy("host").orderBy(F.desc("n"), "layout"))).where(F.col("rank") <= references).select(
        F.col("host").alias("of"), F.col("pick").alias("least"), "layout")
    first = full.join(chosen, (F.col("host") == F.col("of")) & (F.col("pick") == F.col("least"))) \
        .select("host", "layout", "html")
    refs = cut(first.mapInPandas(trees, "host string, layout long, tree string").dropDuplicates(["host", "layout"])
               .groupBy("host").agg(F.array_sort(F.collect_list("tree")).alias("trees")))

    def align(batches):
        made: dict[str, list[Wrapper]] = {}
        for b in batches:
            seen: set = set()
            out = []
            for host, held, html in zip(b["host"], b["trees"], b["html"]):
                if held is None:
                    continue
                w = made.get(host) or made.setdefault(host, [Wrapper(t) for t in held])
                page = Page(html)
                if (same := (host, content(page))) in seen:
                    continue
                seen.add(same)
                ref = Wrapper.nearest(w, page)
                shared = sorted(w[ref].evidence(page))
                out.append((*same, ref, [s for s, _ in shared], [h for _, h in shared]))
            yield pd.DataFrame(out, columns=["host", "page", "ref", "slots", "hs"])

    beside = _beside(full.select("host", "html"), refs, _length("trees"), broadcast_bytes)
    # Copies may differ in what surrounds their content: their evidence is joined.
    counts = cut(beside.mapInPandas(align, "host string, page long, ref int, slots array<int>, hs array<long>")
                 .select("host", "page", "ref", F.explode(F.arrays_zip("slots", "hs")).alias("e"))
                 .select("host", "page", "ref", F.col("e.slots").alias("slot"), F.col("e.hs").alias("h")).distinct()
                 .groupBy("host", "ref", "slot", "h").agg(F.count("*").alias("n")))
    # The reference page itself is no evidence.
    filled = counts.where("h = 0").select("host", "ref", "slot", (F.col("n") - 1).alias("all"))
    constant = counts.where("h <> 0").join(filled, ["host", "ref", "slot"]).where(
        (F.col("all") >= least_pages) & (F.col("n") - 1 >= least_share * F.col("all")))
    wrappers = cut(refs.join(constant.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("ref", "slot", "h")))
                                                          .alias("template")), "host", "left"))

    def extract(batches):
        made: dict[str, list[Wrapper]] = {}
        for b in batches:
            texts = []
            for host, held, template, html in zip(b["host"], b["trees"], b["template"], b["html"]):
                if held is None:  # no page of the host has text
                    texts.append("")
                    continue
                w = made.get(host)
                if w is None:
                    held_by = [[] for _ in held]
                    for t in template if template is not None else ():
                        held_by[t["ref"]].append((t["slot"], t["h"]))
                    w = made[host] = [Wrapper(t, known) for t, known in zip(held, held_by)]
                page = Page(html)
                texts.append(w[Wrapper.nearest(w, page)].extract(page))
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    size = _length("trees") + 32 * F.coalesce(F.size("template"), F.lit(0))
    ids = rows.drop("pick").withColumn("id", F.col("id").cast("string"))
    return told(_beside(ids, wrappers, size, broadcast_bytes).mapInPandas(
        extract, "id string, url string, text string, n_chars long"))
