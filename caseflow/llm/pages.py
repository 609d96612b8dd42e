"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements whose leaves are runs of text. Every leaf gets features of its own, of its
ancestors (subtree density, share of links, attribute tokens), of its depth and of its siblings. Boosted trees
(Spark's own, fitted on a bounded sample of pages) give the chance that a leaf is article text. Decoding then picks
for every element one of three states, best for its whole subtree: all article, all not, or mixed, which costs
something. So a short paragraph inside an article, or a long advert in a side column, follows its surroundings.

Pages carry no labels. The sample is labelled by its own markup where that is explicit (an article or main element;
navigation, footer, aside, advert, comment and form elements). In every other row of the sample the token features
are blanked, so that the trees also learn to tell text by density and place where markup says nothing. Every third
article row is repeated with a token of one of the refused kinds and the label such markup gives, since a sample of
pages need not show all kinds. Every page is also taken in a second form, its telling elements turned into plain
divisions at varying depths and its article cut to a few runs of text, so that size, depth and element names do not
stand in for the layout.
Rows with tokens are repeated with the other features of another row, so that tokens, where there are any, weigh more
than layout. Each split sees a third of the features, so that no single one decides alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import staged, table, text_blocks

SAMPLE_PAGES = 300
SAMPLE_CHARS = 200_000
TREES, DEPTH = 20, 4
#: What a mixed element costs, in nats.
MIXED = 4.0
BLOCK_BYTES = 1 << 20

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*>""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements whose text never counts.
SILENT = frozenset("head noscript template svg annotation annotation-xml object video audio canvas button select datalist map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split()
)
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
#: Elements in which "/>" closes.
FOREIGN = frozenset({"svg", "math"})
UNQUOTED_END = re.compile(r"""=\s*[^\s"'>]*/$""")
#: Start tags that close an open element of these names, up to the named limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
GROUPS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager", "header": "header masthead topbar banner logo",
    "footer": "footer copyright legal bottom contentinfo", "side": "aside sidebar rail widget complementary",
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion adsense", "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe paywall",
    "form": "form search login signup fieldset", "comment": "comment comments reply replies disqus discussion respond", "share": "share sharing social related recommended recommendations trending",
    "main": "article main content post entry story prose",
}
NAMES = list(GROUPS)
GROUP_OF = {t: i for i, words in enumerate(GROUPS.values()) for t in words.split()}
MAIN, HEADER = NAMES.index("main"), NAMES.index("header")
#: Elements that are refused by name even where they hold all marked text.
ASIDE = frozenset({"nav", "aside", "footer"})
REFUSED = [i for i, n in enumerate(NAMES) if n not in ("main", "header")]
KEPT_AROUND = ~sum(1 << i for i in [*REFUSED, HEADER])
WORD = re.compile(r"[a-z]+")
N_OWN = 21


class Page:
    """Block elements (``parent``, ``tag``, ``groups``, ``depth``) and the runs of text below them (``leaf``, ``text``, ``linked``)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.depth, self.kids = [-1], ["#root"], [0], [0], [0]
        self.leaf: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # name and number of the block element it is or lies in
        opened: Counter = Counter()  # how many elements of each name are on the stack
        run: list[str] = []
        links, silent, linked, at, end = 0, 0, 0, 0, len(source)

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.leaf.append(stack[-1][1])
                    self.text.append(text)
                    self.linked.append(min(linked, len(text)))
                run.clear()
            linked = 0

        def pop() -> None:
            nonlocal links, silent
            name, _ = stack.pop()
            opened[name] -= 1
            links -= name == "a"
            silent -= name in SILENT

        def words(a: int, b: int) -> None:
            nonlocal linked
            if a < b and stack[-1][0] == "head" and source[a:b].strip():
                pop()
            if a < b and not silent:
                piece = source[a:b]
                piece = html.unescape(piece) if "&" in piece else piece
                run.append(piece)
                linked += len(piece) if links else 0

        while at < end:
            tag = TOKEN.search(source, at)
            if not tag:
                words(at, end)
                break
            words(at, tag.start())
            at = tag.end()
            name = tag[1] or tag[3]
            if not name:
                continue
            name = name.lower()
            if source[tag.start() + 1] == "/":
                if name not in INLINE:
                    flush()
                if opened[name] > 0:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name == "head" and opened["body"]:
                continue
            if name == "body" and opened["head"]:
                while stack[-1][0] != "head":
                    pop()
            if stack[-1][0] == "head" and name not in IN_HEAD:
                pop()
            if name == "br":
                run.append(" ")
            if name not in INLINE:
                flush()
            given = tag[2] or tag[4] or ""
            if given.endswith("/") and not UNQUOTED_END.search(given) and (name in FOREIGN or any(opened[n] for n in FOREIGN)):
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                at = end if not close else max(source.find(">", close.start()) + 1, close.end())
                continue
            if name in VOID:
                continue
            self._close(stack, opened, name, pop)
            block = stack[-1][1]
            if name not in INLINE:
                self.kids[block] += 1
                self.parent.append(block)
                self.tag.append(name)
                self.groups.append(_groups(name, given))
                self.depth.append(self.depth[block] + 1)
                self.kids.append(0)
                block = len(self.parent) - 1
            stack.append((name, block))
            opened[name] += 1
            links += name == "a"
            silent += name in SILENT
        flush()
        self._clear_around()

    def _clear_around(self) -> None:
        """Refused kinds go from html, body and the elements that hold every element marked as article."""
        own = [int(g >> MAIN & 1 and t not in ("html", "body")) for g, t in zip(self.groups, self.tag)]
        held = list(own)
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        for i, t in enumerate(self.tag):
            around = held[i] == held[0] and held[i] > own[i] and t not in ASIDE
            if around or t in ("html", "body"):
                self.groups[i] &= KEPT_AROUND

    @staticmethod
    def _close(stack: list, opened: Counter, name: str, pop) -> None:
        names, limits = CLOSES.get(name, (set(), set()))
        if name in CLOSES_P:
            names, limits = {"p"}, {"table", "article", "section", "div", "td", "th", "li", "blockquote", "button"}
        if not any(opened[n] for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                while len(stack) > depth:
                    pop()
                if name not in ("tr",):
                    return
            elif stack[depth][0] in limits:
                return

    def features(self) -> np.ndarray:
        """A row for each run of text."""
        n, m = len(self.parent), len(self.text)
        chars = np.array([len(t) for t in self.text], float)
        linked = np.array(self.linked, float)
        leaf = np.array(self.leaf, int)
        total, links, tags = np.bincount(leaf, chars, n), np.bincount(leaf, linked, n), np.ones(n)
        path = list(self.groups)
        for i in range(1, n):
            path[i] |= path[self.parent[i]]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            total[p] += total[i]
            links[p] += links[i]
            tags[p] += tags[i]
        up = np.array(self.parent)
        up[0] = 0
        first, second = up[leaf], up[up[leaf]]
        density, share = total / tags, links / np.maximum(total, 1)
        order = np.zeros(n)
        seen: dict[int, int] = {}
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            order[i] = seen[self.parent[i]] = seen.get(self.parent[i], 0) + 1
            alike[self.parent[i], self.tag[i]] = alike.get((self.parent[i], self.tag[i]), 0) + 1
        kids = np.array(self.kids, float)
        tag = [self.tag[i] for i in self.leaf]
        stops = np.array([sum(map(t.count, ".,;!?")) for t in self.text], float)
        own = np.stack(
            [
                chars, np.array([t.count(" ") + 1 for t in self.text], float), linked / np.maximum(chars, 1), stops / np.maximum(chars, 1),
                np.array([t == "p" for t in tag], float), np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tag], float), np.array([t == "li" for t in tag], float),
                np.array([t in ("td", "th", "dt", "dd") for t in tag], float), np.array(self.depth, float)[leaf], kids[first], order[leaf] / np.maximum(kids[first], 1),
                np.array([alike.get((self.parent[i], self.tag[i]), 0) for i in self.leaf], float), density[leaf], density[first], density[second], share[first], share[second],
                total[first] / max(total[0], 1), np.arange(m) / max(m, 1), np.concatenate([[0], chars[:-1]]), np.concatenate([chars[1:], [0]]),
            ], 1,
        ) if m else np.zeros((0, N_OWN))
        groups = np.array([path[i] for i in self.leaf], int)
        tokens = np.stack([(groups >> g) & 1 for g in range(len(NAMES))], 1).astype(float) if m else np.zeros((0, len(NAMES)))
        return with_balance(np.hstack([own, tokens]))

    def decode(self, chance: np.ndarray) -> list[str]:
        """The runs of text that are article text, by the best consistent states of the elements."""
        n = len(self.parent)
        weight = 1 + np.log1p(np.array([len(t) for t in self.text], float))
        yes, no = weight * np.log(chance), weight * np.log1p(-chance)
        leaf = np.array(self.leaf, int)
        every, none, mixed = np.bincount(leaf, yes, n), np.bincount(leaf, no, n), np.bincount(leaf, np.maximum(yes, no), n)
        for i in range(n - 1, -1, -1):
            mixed[i] -= MIXED
            if i:
                p = self.parent[i]
                every[p] += every[i]
                none[p] += none[i]
                mixed[p] += max(every[i], none[i], mixed[i])
        state = np.zeros(n, int)
        for i in range(n):
            above = 2 if i == 0 else state[self.parent[i]]
            state[i] = above if above != 2 else int(np.argmax((none[i], every[i], mixed[i])))
        return [t for t, i, y, x in zip(self.text, self.leaf, yes, no) if state[i] == 1 or (state[i] == 2 and y > x)]


def _groups(name: str, attributes: str) -> int:
    words = [name]
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            what, value = m[1].lower(), m[2] or ""
            if what == "hidden" or (what == "style" and HIDDEN.search(value)):
                words.append("notice")
            elif what != "style":
                words += WORD.findall(value.lower())
    found = 0
    for w in words:
        if w in GROUP_OF:
            found |= 1 << GROUP_OF[w]
    return found


TELLING = re.compile(r"<(/?)(article|main|nav|aside|header|footer|section)\b", re.I)


def plain_form(source: str, number: int) -> Page:
    """The page with divisions for its telling elements, named by their role, and the first runs of its article.

    ``number`` says how many runs (1 to 7) and how many more divisions lie around (0 to 2).
    """
    runs, around = 1 + number % 7, number % 3
    page = Page(TELLING.sub(lambda m: "</div>" * around + "</div" if m[1] else "<div>" * around + f'<div role="{m[2].lower()}"', source))
    path = list(page.groups)
    for i in range(1, len(path)):
        path[i] |= path[page.parent[i]]
    main = np.array([path[i] >> MAIN & 1 for i in page.leaf], int)
    keep = np.flatnonzero((main == 0) | (np.cumsum(main) <= runs))
    page.leaf, page.text, page.linked = ([x[i] for i in keep] for x in (page.leaf, page.text, page.linked))
    return page


def with_balance(rows: np.ndarray) -> np.ndarray:
    """Rows with two more features: how many refused kinds the path names (a header outside an article is one), and whether it names the article and none of them."""
    tokens = rows[:, N_OWN : N_OWN + len(NAMES)]
    refused = tokens[:, REFUSED].sum(1) + tokens[:, HEADER] * (1 - tokens[:, MAIN])
    return np.hstack([rows[:, : N_OWN + len(NAMES)], refused[:, None], (tokens[:, MAIN] * (refused == 0))[:, None]])


def markup_label(row: np.ndarray) -> float | None:
    """1 or 0 where the markup around a run of text is explicit, else nothing."""
    groups = row[N_OWN:]
    if groups[REFUSED].any() or (groups[HEADER] and not groups[MAIN]):
        return 0.0
    return 1.0 if groups[MAIN] and not groups[HEADER] else None


class Forest:
    """Boosted trees as arrays: feature (or -1), threshold, children, value by node."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]):
        self.trees = [tuple(np.array(x) for x in zip(*nodes)) for nodes in trees]
        self.weights = weights

    def chance(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(rows), int)
            for _ in range(len(feature)):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                goes_left = rows[each, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += weight * value[at]
        return np.clip(1 / (1 + np.exp(-2 * total)), 1e-3, 1 - 1e-3)


def _nodes(root) -> list[tuple]:
    out: list[tuple] = []

    def visit(node) -> int:
        at = len(out)
        out.append((-1, 0.0, at, at, float(node.prediction())))
        if node.subtreeDepth() > 0:
            split = node.split()
            left, right = visit(node.leftChild()), visit(node.rightChild())
            out[at] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)
        return at

    visit(root)
    return out


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Forest:
    """Boosted trees on the explicit markup of at most ``sample_pages`` pages, those with the smallest hash of their id.

    Rows that repeat a page are one page of the sample; of pages that share an id each counts.
    """
    small = pages.filter(F.col("page_id").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    key = F.struct(F.xxhash64("page_id").alias("place"), F.col("page_id"), F.xxhash64("html").alias("content"))
    keyed = small.select(key.alias("key"), "html")
    last = keyed.select("key").distinct().orderBy("key").limit(sample_pages).agg(F.max("key").alias("key"))
    # a parallel scan keeps the pages up to the last key; only those meet in one task, in the order of their keys
    drawn = keyed.join(F.broadcast(last.withColumnRenamed("key", "last")), F.col("key") <= F.col("last"))  # one row
    drawn = staged(drawn.groupBy("key").agg(F.min("html").alias("html")), "pages")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            sources = [s or "" for s in batch.column("html").to_pylist()]
            forms = [p for n, s in enumerate(sources) for p in (Page(s), plain_form(s, n))]
            for page in forms:
                for k, row in enumerate(page.features()):
                    label = markup_label(row)
                    if label is None:
                        continue
                    if label and k % 3 == 0:
                        marked = row.copy()
                        kind = [*REFUSED, HEADER][k // 3 % (len(REFUSED) + 1)]
                        marked[N_OWN + kind] = 1
                        marked[N_OWN + MAIN] *= kind != HEADER
                        rows.append(with_balance(marked[None])[0].tolist())
                        labels.append(0.0)
                    if k % 2:
                        row[N_OWN:] = 0
                    rows.append(row.tolist())
                    labels.append(label)
            named = [i for i, r in enumerate(rows) if any(r[N_OWN:])]
            mixed = [rows[j][:N_OWN] + rows[i][N_OWN:] for i, j in zip(named, named[17:] + named[:17])]
            rows, labels = rows + mixed, labels + [labels[i] for i in named]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], names=["features", "label"])

    ordered = drawn.repartition(1).sortWithinPartitions("key").select("html")
    sample = staged(ordered.mapInArrow(run, "features array<double>, label double"), "nodes")
    if sample.select("label").distinct().count() < 2:
        # one class or none: article text is what lies in main elements, or anything outside the refused ones
        nodes: list[tuple] = []
        for group in [*REFUSED, HEADER]:
            nodes.append((N_OWN + group, 0.5, len(nodes) + 2, len(nodes) + 1, 0.0))
            nodes.append((-1, 0.0, len(nodes), len(nodes), -1.5))
        return Forest([[*nodes, (-1, 0.0, len(nodes), len(nodes), 1.5)]], [1.0])
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, featureSubsetStrategy="onethird", seed=7).fit(sample.select(array_to_vector("features").alias("features"), "label"))
    return Forest([_nodes(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))


def extract(pages: DataFrame, model: Forest) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    Null and empty html gives empty text, as do pages without article text. White space (of any kind, after character
    references are decoded) becomes one space; blocks are joined by an empty line.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK_BYTES, "html"):
            parsed = [Page(h or "") for h in block.column("html").to_pylist()]
            rows = [p.features() for p in parsed]
            chance = shared.value.chance(np.concatenate(rows))
            ends = np.cumsum([len(r) for r in rows])
            texts = ["\n\n".join(p.decode(chance[e - len(r) : e])) for p, r, e in zip(parsed, rows, ends)]
            at = block.schema.get_field_index("html")
            yield from block.set_column(at, "text", pa.array(texts, pa.string())).combine_chunks().to_batches()

    own = pages.select("page_id", "url", "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:2])
    return own.mapInArrow(run, f"{schema}, text string")


def op3_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
