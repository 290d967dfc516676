"""The main text of web pages by boosted trees over DOM nodes and a hierarchical decoding.

A tolerant reader turns a page into nodes (block elements, and inline ones whose
attributes tell something) and runs of text. Gradient-boosted trees give each node
the chance to belong to the main text, from the density of its subtree, tokens of its
attributes and of those above it, depth, and how it stands among its siblings. The
decoding picks the likeliest set of kept nodes in which nothing is kept below a node
that is dropped.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, in_slices, stored, texts_of

# A quote opens a value only after an equals sign; elsewhere it is a letter.
_IN_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+"""
_MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)({_IN_TAG})>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]+))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.!?;,:]")

# Elements of HTML by what they do to text.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object textarea title head audio video canvas select".split())
CLOSES_P = BLOCKS - set("body html button option label legend td th tr tbody thead tfoot dd dt li".split())
BOILERPLATE_TAGS = set("nav aside footer form button menu dialog label fieldset legend option".split())
# Words in class, id and role attributes.
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay"
    " newsletter subscribe subscription signup login signin nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar topbar header masthead"
    " footer contentinfo copyright legal sidebar aside complementary widget widgets related recommended recommendations trending popular share sharing social"
    " comment comments commentlist reply replies respond disqus discussion reactions form search searchform skip toc tags hidden".split()
)
CONTENT_WORDS = set("article content contents main post entry story body text prose maincontent articlebody postbody entrycontent".split())

# Of these words, those that often stand for a subject as well; they tell nothing in a name beside a word that is none of a page's parts.
SUBJECT_WORDS = set("alert notice social legal popular share sharing form search related trending header skip promotion reactions discussion reply comment subscription".split())
PART_WORDS = set(
    "box bar list lists link links button buttons section sections wrapper wrap container area block inner outer left right top bottom site page pages post posts item items"
    " panel icon icons media this us now more reading title group row col column desktop mobile js no is has with open fixed sticky global primary secondary the a of by to"
    " count counter meta info nav stories articles news feed tools field fields input inputs submit message messages thread threads top left my all for and on".split()
)

_GROUPS = ["nav menu", "header", "footer", "aside", "form button label fieldset legend option", "article main", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dd dt", "div section", "table tbody thead tfoot tr td th"]
_GROUP_OF = {tag: i for i, tags in enumerate(_GROUPS) for tag in tags.split()}
STAYS = 5.0
N_FEATURES = len(_GROUPS) + 18


class Page:
    """Nodes and runs of text of a page. Parents come before their children."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.bad, self.good, self.hides = ["html"], [-1], [0], [False], [False], [False]
        self.chars, self.links, self.stops, self.words = [0], [0], [0], [0]
        self.runs: list[list[tuple[int, str]]] = [[]]
        self._open: list[tuple[str, int]] = [("html", 0)]  # elements with the node that holds their text
        self._places: dict[str, list[int]] = {}  # where elements of a name stand among the open ones
        self._blocks: list[int] = []  # where open blocks stand
        self._read(source)
        self._sum_up()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = _MARKUP.search(source, at)
            if found is None:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._end(name)
                continue
            attributes = found[3] or found[6] or ""
            if name in RAW and not attributes.endswith("/"):
                over = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
                if name in ("script", "style", "textarea", "title") or over:
                    at = over.end() if over else size
                continue
            self._start(name, attributes)

    def _text(self, text: str) -> None:
        node = self._open[-1][1]
        if "&" in text:
            text = html.unescape(text)
        self.runs[-1].append((node, text))
        bare = len(text) - text.count(" ")
        if bare:
            self.chars[node] += bare
            self.words[node] += text.count(" ") + 1
            self.stops[node] += len(_PUNCTUATION.findall(text))
            if self._places.get("a"):
                self.links[node] += bare

    def _break(self) -> None:
        if self.runs[-1]:
            self.runs.append([])

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.runs[-1].append((self._open[-1][1], " "))
            return
        block = name in BLOCKS
        if block:
            self._break()
            if name in CLOSES_P:
                self._close(("p",), ("table", "td", "th", "button"))
            if name == "li":
                self._close(("li",), ("ul", "ol", "menu"))
            elif name in ("td", "th"):
                self._close(("td", "th"), ("tr", "table"))
            elif name == "tr":
                self._close(("tr",), ("table",))
            elif name in ("dd", "dt"):
                self._close(("dd", "dt"), ("dl",))
            elif name == "option":
                self._close(("option",), ("select",))
        if name in VOID:
            return
        bad = good = hides = False
        if attributes.strip(" /"):
            bad, good, hides = _told(attributes)
        node = self._open[-1][1]
        if block or bad or good:
            self.tags.append(name)
            self.parents.append(node)
            self.depths.append(self.depths[node] + 1)
            self.bad.append(bad)
            self.good.append(good)
            self.hides.append(hides)
            for column in (self.chars, self.links, self.stops, self.words):
                column.append(0)
            node = len(self.tags) - 1
        if attributes.endswith("/") and not block:
            return
        self._places.setdefault(name, []).append(len(self._open))
        if block:
            self._blocks.append(len(self._open))
        self._open.append((name, node))

    def _nearest(self, names: tuple[str, ...]) -> int:
        return max((places[-1] for name in names if (places := self._places.get(name))), default=0)

    def _close(self, names: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        """End the nearest open element of ``names``, unless a barrier is nearer."""
        at = self._nearest(names)
        if at > self._nearest(barriers):
            self._leave(at)

    def _end(self, name: str) -> None:
        """End the nearest open element of a name; an inline one only within its block."""
        block = name in BLOCKS
        if block:
            self._break()
        at = self._nearest((name,))
        if at and (block or not self._blocks or at > self._blocks[-1]):
            self._leave(at)

    def _leave(self, i: int) -> None:
        for name, _ in self._open[i:]:
            self._places[name].pop()
        while self._blocks and self._blocks[-1] >= i:
            self._blocks.pop()
        del self._open[i:]

    def _sum_up(self) -> None:
        count = len(self.tags)
        self.parent = np.array(self.parents)
        own = np.array([self.chars, self.links, self.stops, self.words, [1] * count], float)
        self.own_words = own[3].copy()
        prose = own[0] - own[1]
        for i in range(count - 1, 0, -1):
            own[:, self.parents[i]] += own[:, i]
        self.total = own
        self._excuse_wrappers(prose)

    def _excuse_wrappers(self, prose: np.ndarray) -> None:
        """Take back what attributes say of elements that hold the page: its root and body, articles, wrappers around most of its text."""
        within = self.total[0] - self.total[1]
        articles = [False] * len(self.tags)
        for i, tag in enumerate(self.tags):
            p = self.parents[i]
            nested = i > 0 and articles[p]
            articles[i] = nested or tag == "article"
            if tag in ("html", "body") or tag in ("article", "main") and not self.hides[i] and not nested:
                self.bad[i] = False
        for i in range(1, len(self.tags)):
            if self.bad[i] and not self.hides[i] and 2 * within[i] > within[0]:
                self.bad[i] = not self._holds_page(i, prose, within)

    def _holds_page(self, wrapper: int, prose: np.ndarray, within: np.ndarray) -> bool:
        """Whether the main text can only be in the wrapper: most of it in an element that says so, or next to nothing outside but boilerplate."""
        below, outside, elsewhere = {wrapper}, [False] * len(self.tags), 0.0
        for i, tag in enumerate(self.tags):
            p = self.parents[i]
            if i > wrapper and p in below:
                below.add(i)
                if (tag in ("article", "main") or self.good[i] and not self.bad[i]) and 2 * within[i] > within[wrapper]:
                    return True
            outside[i] = i > 0 and outside[p] or self.bad[i] or tag in BOILERPLATE_TAGS or tag == "header"
            if not outside[i]:
                elsewhere += prose[i]
        return elsewhere <= 0.1 * within[wrapper]

    def features(self) -> np.ndarray:
        count = len(self.tags)
        chars, links, stops, words, nodes = self.total
        parent = np.maximum(self.parent, 0)
        out = np.zeros((count, N_FEATURES), np.float32)
        group = np.array([_GROUP_OF.get(tag, -1) for tag in self.tags])
        out[np.flatnonzero(group >= 0), group[group >= 0]] = 1
        tag_bad = np.array([tag in BOILERPLATE_TAGS for tag in self.tags])
        bad, good = np.array(self.bad) | tag_bad, np.array(self.good) | (group == 5)
        above_bad, above_good, above_header = (np.zeros(count, bool) for _ in range(3))
        seat, seats, alike = np.zeros(count), np.zeros(count), np.zeros(count)
        kinds: dict[tuple[int, str], int] = {}
        for i in range(1, count):
            p = self.parents[i]
            above_bad[i] = above_bad[p] or bad[p]
            above_good[i] = above_good[p] or good[p]
            above_header[i] = above_header[p] or self.tags[p] == "header"
            seat[i] = seats[p]
            seats[p] += 1
            kinds[p, self.tags[i]] = kinds.get((p, self.tags[i]), 0) + 1
        for i in range(1, count):
            alike[i] = kinds[self.parents[i], self.tags[i]]
        siblings = np.maximum(seats[parent], 1)
        base = len(_GROUPS)
        columns = [
            np.array(self.bad), tag_bad, np.array(self.good), above_bad, above_good, above_header, self.depths,
            np.log1p(chars), np.log1p(words), links / np.maximum(chars, 1), nodes / np.maximum(chars, 1), stops / np.maximum(words, 1),
            chars / np.maximum(words, 1), siblings, seat / siblings, alike / siblings, chars / np.maximum(chars[parent], 1), np.arange(count) / count,
        ]
        for k, column in enumerate(columns):
            out[:, base + k] = column
        return out

    def labels(self) -> np.ndarray:
        """What the markup itself tells of each node: 1 main text, 0 something else, -1 nothing."""
        count = len(self.tags)
        out = np.full(count, -1)
        chars, links, stops, words, _ = self.total
        inside, outside = np.zeros(count, bool), np.zeros(count, bool)
        for i in range(count):
            p = self.parents[i]
            tag = self.tags[i]
            inside[i] = i and inside[p] or tag in ("article", "main") or self.good[i] and not self.bad[i]
            outside[i] = i and outside[p] or self.bad[i] or tag in BOILERPLATE_TAGS or tag == "header" and not inside[i]
            if outside[i]:
                out[i] = 0
            elif inside[i] and chars[i] and links[i] <= 0.5 * chars[i]:
                out[i] = 1
            elif chars[i] and links[i] > 0.6 * chars[i]:
                out[i] = 0
            elif tag in ("p", "pre", "blockquote") and words[i] >= 20 and stops[i] and links[i] <= 0.2 * chars[i]:
                out[i] = 1
        for i in range(count - 1, 0, -1):  # what holds main text is to be kept as well
            if out[i] == 1 and out[self.parents[i]] == -1:
                out[self.parents[i]] = 1
        out[0] = -1 if not chars[0] else 1
        return out

    def decoded(self, chances: np.ndarray) -> np.ndarray:
        """The kept nodes: the likeliest choice with nothing kept below a dropped node.

        Nodes weigh by their own words. Below a likely parent the odds of a node that bears no
        mark of boilerplate rise by ``STAYS``, as such nodes mostly go with their parents.
        """
        count = len(self.tags)
        unmarked = [not bad and tag not in BOILERPLATE_TAGS for bad, tag in zip(self.bad, self.tags)]
        stays = np.where(np.array(unmarked) & (chances[np.maximum(self.parent, 0)] >= 0.5) & (self.parent >= 0), STAYS, 1.0)
        chances = chances * stays / (1 + chances * (stays - 1))
        weights = 1 + np.log1p(self.own_words)
        yes, no = weights * np.log(chances), weights * np.log1p(-chances)
        drop, best = no.copy(), np.zeros(count)
        below = np.zeros(count)
        take = np.zeros(count, bool)
        for i in range(count - 1, -1, -1):
            keep = yes[i] + below[i]
            take[i] = keep >= drop[i] or i == 0
            best[i] = max(keep, drop[i])
            if i:
                below[self.parents[i]] += best[i]
                drop[self.parents[i]] += drop[i]
        for i in range(1, count):
            take[i] &= take[self.parents[i]]
        return take

    def text(self, kept: np.ndarray) -> str:
        keep = kept.tolist()
        blocks = (" ".join("".join([piece for node, piece in run if keep[node]]).split()) for run in self.runs)
        return "\n".join([block for block in blocks if block])


def _told(attributes: str) -> tuple[bool, bool, bool]:
    """Whether attributes speak of boilerplate or hide the element, whether of main text, and whether they hide it."""
    bad = good = hides = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role", "itemprop"):
            for single in value.split():
                words = [word.lower() for word in _TOKEN.findall(single)]
                words += [a + b for a, b in zip(words, words[1:])]
                good |= not CONTENT_WORDS.isdisjoint(words)
                speaking = BOILERPLATE_WORDS.intersection(words)
                if speaking <= SUBJECT_WORDS and any(len(w) > 2 and w not in BOILERPLATE_WORDS | CONTENT_WORDS | PART_WORDS for w in _TOKEN.findall(single.lower())):
                    continue  # such as a name of a chapter
                bad |= bool(speaking)
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hides = True
    bad |= hides
    if _HIDDEN.search(attributes):
        bad = True
        hides |= _HIDDEN.search(_ATTRIBUTE.sub(r"\1=x", attributes)) is not None
    return bad, good, hides


class BoostedTrees:
    """Gradient-boosted trees of one depth for a two-class target, on features cut at quantiles."""

    def __init__(self, depth: int = 4, rounds: int = 50, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(cut, x[:, f], side="left") for f, cut in enumerate(cuts)], 1)
        share = np.clip(y.mean(), 0.02, 0.98)
        self.base = math.log(share / (1 - share))
        margin = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        trees = []
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-margin))
            gradient, hessian = y - chance, chance * (1 - chance)
            feature, cut_at, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = self._best_split(binned, cuts, gradient, hessian, rows)
                if best:
                    feature[node], place = best
                    cut_at[node] = cuts[feature[node]][place]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut_at[node])
            leaf = at - inner
            sums = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, hessian, inner + 1)
            value = self.rate * sums[0] / (sums[1] + self.ridge)
            margin += value[leaf]
            trees.append((feature, cut_at, value))
        self.feature, self.cut_at, self.value = (np.stack(part) for part in zip(*trees))
        return self

    def _best_split(self, binned, cuts, gradient, hessian, rows) -> tuple[int, int] | None:
        if len(rows) < 10:
            return None
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        best, gain = None, 1e-6
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], g, len(cut) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], h, len(cut) + 1))[:-1]
            score = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
            place = int(np.argmax(score))
            if score[place] > gain:
                best, gain = (f, place), score[place]
        return best

    def chances(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = 2**self.depth - 1
        for feature, cut_at, value in zip(self.feature, self.cut_at, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut_at[at])
            margin += value[at - inner]
        return np.clip(1 / (1 + np.exp(-margin)), 1e-6, 1 - 1e-6)


def example_pages(count: int = 240) -> list[str]:
    """Pages of many layouts that add to every sample, so that each kind of boilerplate is seen, and pages without marks as well."""
    random = np.random.default_rng(11)
    stock = "this part of the story goes on for a while and then tells a little more about what was seen there by those who came".split()

    def prose(least: int, most: int) -> str:
        words = [str(w) for w in random.choice(stock, random.integers(least, most))]
        for i in range(len(words)):
            if i % 11 == 10 or i == len(words) - 1:
                words[i] += "." if i % 2 or i == len(words) - 1 else ","
        return " ".join(words).capitalize()

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{prose(1, 4)}</a></li>' for i in range(n))

    def boilerplate() -> str:
        word = str(random.choice(sorted(BOILERPLATE_WORDS)))
        tag = str(random.choice(["div", "section", "p", "ul"]))
        inside = [f"<p>{prose(4, 40)}</p>" * int(random.integers(1, 4)), prose(3, 25), f"<h3>{prose(1, 4)}</h3><ul>{links(4)}</ul>", links(5)][random.integers(4)]
        name = ["class", "id", "role"][random.integers(3)]
        element = str(random.choice(sorted(BOILERPLATE_TAGS - {"option"})))
        return [f'<{tag} {name}="{word}">{inside}</{tag}>', f"<{element}>{inside}</{element}>", f'<div class="site-{word} box">{inside}</div>'][random.integers(3)]

    pages = []
    for i in range(count):
        body = ""
        for k in range(int(random.integers(1, 9))):
            body += f"<p>{prose(5, 90)}</p>"
            kind = random.integers(12)
            if kind == 0:
                body += f"<h2>{prose(1, 6)}</h2>"
            elif kind == 1:
                body += f"<ul><li>{prose(2, 12)}</li><li>{prose(2, 12)}</li></ul>"
            elif kind == 2:
                body += f"<table><tr><td>{prose(1, 4)}</td><td>{prose(1, 4)}</td></tr></table><blockquote>{prose(8, 30)}</blockquote>"
            elif kind < 5:
                body += boilerplate()
            elif kind == 5:
                body += f'<p>{prose(5, 20)} <span class="{random.choice(sorted(BOILERPLATE_WORDS))}">{prose(1, 6)}</span> {prose(5, 20)}</p>'
        title = f"<h1>{prose(2, 9)}</h1>"
        word = str(random.choice(sorted(CONTENT_WORDS)))
        article = [f"<article>{title}{body}</article>", f'<div class="{word}">{title}{body}</div>', f"<main>{title}{body}</main>", f'<main><article><header>{title}<p>{prose(2, 6)}</p></header>{body}</article></main>', f'<div id="the-{word}">{body}</div>'][i % 5]
        around = [boilerplate() for _ in range(int(random.integers(0, 5)))]
        head = f"<header><p>{prose(2, 9)}</p><ul>{links(4)}</ul></header>" if random.integers(2) else f"<nav><ul>{links(6)}</ul></nav>"
        cut = int(random.integers(0, len(around) + 1))
        bare = i % 12 == 0
        pages.append(f"<html><body>{'' if bare else head + ''.join(around[:cut])}{article}{'' if bare else ''.join(around[cut:])}</body></html>")
    for i in range(count):  # short articles, down to a word, between much, little or nothing
        parts = [prose(1, int(random.integers(2, 31))) for _ in range(int(random.integers(1, 4)))]
        body = parts[0] if i % 4 == 0 else "".join(f"<p>{part}</p>" for part in parts)
        before = [f"<nav><ul>{links(int(random.integers(1, 7)))}</ul></nav>", f"<header><p>{prose(1, 9)}</p></header>", boilerplate(), ""][int(random.integers(4))]
        after = [f"<footer><p>{prose(2, 12)}</p></footer>", f"<footer>{prose(1, 9)}</footer>", boilerplate(), ""][int(random.integers(4))]
        page = f"{before}<article>{body}</article>{after}"
        pages.append(page if i % 3 == 0 else f"<html><body>{page}</body></html>")
        if i % 8 == 0 and before + after:
            pages.append(f"<html><body>{before}{after}</body></html>")
    return pages


_MEANING = re.compile(r"<(/?)(article|main|nav|aside|footer|header|form|section)\b[^>]*>", re.IGNORECASE)
_MAIN = re.compile(r"<(/?)(article|main)\b[^>]*>", re.IGNORECASE)
_NAMED = re.compile(r"<(div|ul|p|section)\s[^>]*>", re.IGNORECASE)


def without_marks(source: str) -> str:
    """The page with plain div elements in place of those that tell their purpose, and no attributes on blocks."""
    return _NAMED.sub(r"<\1>", _MEANING.sub(r"<\1div>", source))


def without_main_marks(source: str) -> str:
    """The page with plain div elements in place of articles."""
    return _MAIN.sub(r"<\1div>", source)


def learn_nodes(pages: DataFrame, sample_pages: int = 150) -> BoostedTrees:
    """Trees fitted to the nodes of at most ``sample_pages`` pages, the first by a hash of their ids, and of ``example_pages``."""
    chosen = pages.filter(F.col("html").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    sample = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(chosen), "page_id", "left_semi")  # sample_pages ids at most

    def nodes(batches: Batches) -> Batches:
        for batch in in_slices(batches):
            rows = [_training_rows(source) for source in texts_of(batch.column(1))]
            found = [np.column_stack([y, x]).astype("<f4").tobytes() for x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["page_id", "nodes"])

    collected = sample.mapInArrow(nodes, "page_id long, nodes binary").toPandas().sort_values(["page_id", "nodes"])
    rows = [np.frombuffer(x, "<f4").reshape(-1, N_FEATURES + 1) for x in collected.nodes]
    rows += [np.column_stack([y, x]) for x, y in map(_training_rows, example_pages())]
    together = np.concatenate(rows)
    return BoostedTrees().fit(together[:, 1:], together[:, 0])


def _training_rows(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the page as it is, and once more without the marks that its labels come from, where that has the same nodes."""
    page = Page(source)
    labels = page.labels()
    known = labels >= 0
    versions = [page, *(Page(change(source)) for change in (without_marks, without_main_marks))]
    seen = [version.features()[known] for version in versions if version.depths == page.depths]
    return np.concatenate(seen), np.tile(labels[known], len(seen))


def main_texts(pages: DataFrame, trees: BoostedTrees) -> DataFrame:
    """``pages`` with columns text and n_chars (code points) in place of html.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by a line break in the order of the page, nothing is cut off.
    Null and empty pages, and pages without main text, have an empty text; every row
    stays. Columns of ``pages`` named text or n_chars are replaced.
    """
    kept = pages.drop("text", "n_chars")
    at = kept.columns.index("html")
    others = [i for i in range(len(kept.columns)) if i != at]
    schema = kept.drop("html").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def extracted(batches: Batches) -> Batches:
        for batch in in_slices(batches, 4 << 20):
            parsed = [Page(source) for source in texts_of(batch.column(at))]
            texts = []
            if parsed:
                chances = trees.chances(np.concatenate([page.features() for page in parsed]))
                ends = np.cumsum([len(page.tags) for page in parsed])
                texts = [page.text(page.decoded(part)) for page, part in zip(parsed, np.split(chances, ends[:-1]))]
            columns = [*(batch.column(i) for i in others), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in others), "text", "n_chars"])

    return kept.mapInArrow(extracted, schema)
