"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the kind of element they stand in, unless
one around them is known for boilerplate, tags score negative by how often they stand outside
content, and one linear scan finds the contiguous run of the largest sum, which is the content
region. The weights come from labelled pages, those whose markup names its article, and are learned
as if it did not. What a name or a form says is weighed against the page: an element that holds most
of its running text is a wrapper, whatever it is called.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are fitted to, at most.
SAMPLE = 1000

#: Score of a tag within a content element: there markup says little about where content ends.
WITHIN = -0.05

#: Score of a word in boilerplate, at least: it is left out of the text even inside the region, so it need not end it.
BOILER = -0.2

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mroot mrow ms mspace msqrt msub msubsup msup mtext object q s samp semantics small span strike strong sub sup svg text textpath time tspan tt u var wbr".split())
SILENT = frozenset("script style noscript template textarea select option button iframe head title".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())

# Parts of class names and ids. A name is known for boilerplate if its last part is a noun of it, or if each part
# is such a noun or tells no more than place and form; a header is one only of a whole site, for articles have headers too.
_NOUNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion banner menu nav navbar navigation breadcrumb breadcrumbs footer masthead sidebar aside widget widgets "
    "comment comments respond replies disqus cookie cookies consent notice notices alert popup modal newsletter subscribe signup login pagination pager related share sharing social copyright".split()
)
_PLACES = frozenset("site page main global top bottom left right inner outer box bar slot area block list item items link links wrap wrapper container section panel group row button buttons icon icons primary secondary header".split())
_SITE = frozenset("site global top main".split())
# Words that make a name one of a page's layout, and names of what readers write.
_LAYOUT = frozenset("no not non has with without hide hidden show is layout category tag topic".split())
_READERS = frozenset("comment comments commentlist respond replies reply disqus".split())
#: Element names that words are told by, the innermost that is open.
_BLOCKS = ("p", "li", "td", "h1", "h2", "h3", "pre", "blockquote", "dd", "dt")
#: Log-odds from which a learned role says something, and from which no content element within it counts.
_TELLING, _SURE = -1.0, -2.0

_RAW = "script|style|textarea|template|noscript|iframe|title"
# Every alternative either matches in one pass or runs to the end of the page, as an unfinished tag does by the standard; none gives back.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:\Z|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>?|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?P<end>>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def boilerplate_name(name: str) -> bool:
    """Whether a class name or id is known for what pages have around their articles."""
    parts = [p for p in re.split(r"[-_0-9]+", name) if p]
    if not parts or not _LAYOUT.isdisjoint(parts):
        return False
    if parts[-1] == "header":
        return all(p in _SITE for p in parts[:-1])
    return parts[-1] in _NOUNS or any(p in _NOUNS for p in parts) and all(p in _NOUNS or p in _PLACES for p in parts)


def readers_name(name: str) -> bool:
    """Whether a class name or id, of a content element too, is known for what readers write."""
    parts = [p for p in re.split(r"[-_0-9]+", name) if p]
    return bool(parts) and not _READERS.isdisjoint(parts) and _LAYOUT.isdisjoint(parts)


@dataclass
class Weights:
    """``tags``: name -> score of a tag (negative). ``roles``: element or class name -> log-odds that its words are content.
    ``words``: kind of place -> score of a word there, if nothing else is known of it."""

    tags: dict[str, float] = field(default_factory=dict)
    roles: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)

    def word(self, place: str) -> float:
        return self.words.get(place, -0.3 if place == "a li" else 0.3 if place[:2] == "a " else 1.0)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.05 if name in INLINE or re.fullmatch(r"p|br|h[1-6]", name) else -0.2)

    def role(self, name: str) -> float:
        known = self.roles.get(name)
        if known is not None:
            return known
        return 3.0 if name in CONTENT else -3.0 if name in BOILERPLATE or name[0] == "." and boilerplate_name(name[1:]) else 0.0


class _Around:
    """What the elements around a place say, folded from the outermost in: one step for each role, none is looked at again.

    ``closed``: something surely is boilerplate, and no content element within it opens it again."""

    __slots__ = ("closed", "content", "worst")

    def __init__(self, content: bool = False, worst: float = 0.0, closed: bool = False):
        self.content, self.worst, self.closed = content, worst, closed

    def within(self, roles: list[str], weights: Weights) -> _Around:
        content, worst, closed = self.content, self.worst, self.closed
        for role in roles:
            odds = weights.role(role)
            if role in CONTENT:
                if not closed:
                    content, worst = odds > 0, 0.0
            elif odds <= _TELLING and not (content and role == "header"):  # an article's own header holds its title
                worst, closed = min(worst, odds), closed or odds <= _SURE
        return self if (content, worst, closed) == (self.content, self.worst, self.closed) else _Around(content, worst, closed)

    def word_score(self, usual: float) -> tuple[float, bool]:
        """(score, whether the text has the word): as usual, 1 in a content element, or what the worst role around it says (nothing in a
        content element, where boilerplate need not end the region)."""
        if self.worst < 0:
            return (0.0 if self.content else max(BOILER, self.worst)), False
        return (1.0 if self.content else usual), True


@dataclass
class _Open:
    name: str
    roles: list[str]
    silent: bool
    number: int = -1


class Walker:
    """The page's elements as they open and close. Elements that are not closed end with their parent, a paragraph where a block begins.

    Open elements are kept by name too, so that each tag costs the same however deep it stands."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.at: dict[str, list[int]] = {}
        self.count = 0

    def opened(self, element: _Open) -> None:
        """For subclasses."""

    def closed(self, element: _Open) -> None:
        """For subclasses."""

    def tag(self, name: str) -> None:
        """For subclasses: any tag, before it opens or closes its element."""

    def text(self, text: str) -> None:
        """For subclasses: text outside silent elements."""

    def _last(self, name: str) -> int:
        places = self.at.get(name)
        return places[-1] if places else -1

    def place(self) -> str:
        """Kind of the innermost place of text: within a link or not, and the block."""
        block = max(_BLOCKS, key=self._last)
        return ("a " if self._last("a") >= 0 else "- ") + (block if self._last(block) >= 0 else "")

    def _cut(self, to: int) -> None:
        while len(self.stack) > to:
            element = self.stack.pop()
            self.at[element.name].pop()
            self.closed(element)

    def _begin(self, name: str, rest: str) -> None:
        if name not in INLINE and name != "br":
            at = max(self._last("p"), self._last("li") if name == "li" else -1)
            if at >= 0 and not (name == "li" and max(self._last("ul"), self._last("ol")) > at):
                self._cut(at)
        if name in VOID or rest.endswith("/"):
            return
        own = [name] if name in CONTENT or name in BOILERPLATE else []
        if "=" in rest and name not in ("html", "body"):  # their names are of layout
            for kind, a, b, c in _NAMED.findall(rest):
                names = (a or b or c).lower().split()
                if name in CONTENT:  # what its names say is its subject, unless readers wrote it
                    own = [".comment"] if kind.lower() != "role" and any(map(readers_name, names)) else own
                else:
                    own += [("." if kind.lower() != "role" else "@") + x for x in names]
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(_Open(name, own, name in SILENT or bool(self.stack) and self.stack[-1].silent, self.count))
        self.count += 1
        self.opened(self.stack[-1])

    def walk(self, page: str) -> None:
        for m in _TOKEN.finditer(page):
            if m["text"] is not None:
                if not (self.stack and self.stack[-1].silent):
                    self.text(m["text"])
            elif m["raw"]:
                self.tag(m["raw"].lower())
            elif m["name"] and m["end"]:
                name = m["name"].lower()
                self.tag(name)
                if not m["close"]:
                    self._begin(name, m["rest"])
                elif (at := self._last(name)) >= 0:
                    self._cut(at)
        self._cut(0)


class _Shares(Walker):
    """Words of running text, in paragraphs and in all, of the page and of each element that a weak role (a name or a form) is told by: by its number."""

    def __init__(self, weights: Weights) -> None:
        super().__init__()
        self.weights, self.words, self.shut = weights, [0, 0], 0
        self.began: dict[int, tuple[int, int]] = {}
        self.held: dict[int, tuple[int, int]] = {}

    @staticmethod
    def _strong(role: str) -> bool:
        return role in BOILERPLATE and role != "form" or role[0] == "." and readers_name(role[1:])

    def opened(self, element: _Open) -> None:
        if any(self._strong(r) for r in element.roles):
            self.shut += 1
        elif any(r not in CONTENT and self.weights.role(r) <= _TELLING for r in element.roles):
            self.began[element.number] = tuple(self.words)

    def closed(self, element: _Open) -> None:
        if any(self._strong(r) for r in element.roles):
            self.shut -= 1
        elif (before := self.began.pop(element.number, None)) is not None:
            self.held[element.number] = (self.words[0] - before[0], self.words[1] - before[1])

    def text(self, text: str) -> None:
        if not self.shut:
            n = len(text.split())
            self.words[1] += n
            if self._last("p") >= 0:
                self.words[0] += n

    def wrappers(self) -> set[int]:
        """Elements that hold more than half of the page's running text (of all its text if there is none in paragraphs)."""
        kind = 0 if self.words[0] else 1
        return {number for number, held in self.held.items() if 2 * held[kind] > self.words[kind]}


class _Items(Walker):
    """(score, text or None, tag name) of each text and tag in page order."""

    def __init__(self, weights: Weights, wrappers: set[int] = frozenset()) -> None:
        super().__init__()
        self.weights, self.wrappers, self.around, self.items = weights, wrappers, [_Around()], []

    def opened(self, element: _Open) -> None:
        roles = [r for r in element.roles if r in CONTENT] if element.number in self.wrappers else element.roles
        self.around.append(self.around[-1].within(roles, self.weights))

    def closed(self, element: _Open) -> None:
        self.around.pop()

    def tag(self, name: str) -> None:
        self.items.append((WITHIN if self.around[-1].content else self.weights.tag(name), None, name))

    def text(self, text: str) -> None:
        words = html.unescape(text)
        if n := len(words.split()):
            score, kept = self.around[-1].word_score(self.weights.word(self.place()))
            self.items.append((score * n, words if kept else None, ""))
        else:
            self.items.append((0.0, " ", ""))


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best region, white space collapsed, joined by blank lines; empty if there are no words.

    Each tag and each text is met twice, however deep or broken the markup is: time is in proportion to the page.
    A tag that the page's end cuts off is markup."""
    shares = _Shares(weights)
    shares.walk(page or "")
    found = _Items(weights, shares.wrappers())
    found.walk(page or "")
    items = found.items
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (score, _, _) in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, at = total, (start, i + 1)
    blocks, now = [], []
    for _, text, name in [*items[at[0] : at[1]], (0.0, None, "p")]:
        if text is not None:
            now.append(text)
        elif name == "br":
            now.append(" ")
        elif name and name not in INLINE:
            if block := " ".join("".join(now).split()):
                blocks.append(block)
            now = []
    return "\n\n".join(blocks)


class _Observer(Walker):
    """Words by (role, in content) and tags by (name, in content).

    A role is credited when its outermost element in the same content element closes, with the words met since; a
    content element's words are its own only, so that no role is looked at for each text."""

    def __init__(self) -> None:
        super().__init__()
        self.roles, self.tags, self.places = Counter(), Counter(), Counter()
        self.words, self.levels = [0], [{}]

    def opened(self, element: _Open) -> None:
        if element.name in CONTENT:
            self.words.append(0)
            self.levels.append({})
        for role in element.roles:
            if role not in CONTENT:
                deep, since = self.levels[-1].get(role, (0, self.words[-1]))
                self.levels[-1][role] = (deep + 1, since)

    def closed(self, element: _Open) -> None:
        for role in element.roles:
            if role not in CONTENT:
                deep, since = self.levels[-1].pop(role)
                if deep > 1:
                    self.levels[-1][role] = (deep - 1, since)
                elif n := self.words[-1] - since:
                    self.roles[role, len(self.levels) > 1] += n
        if element.name in CONTENT:
            self.words.pop()
            self.levels.pop()

    def tag(self, name: str) -> None:
        self.tags[name, len(self.levels) > 1] += 1

    def text(self, text: str) -> None:
        if n := len(text.split()):
            self.words[-1] += n
            self.places[self.place(), len(self.levels) > 1] += n


def observe(page: str) -> tuple[Counter, Counter, Counter]:
    """Words by (role, in content), tags by (name, in content) and words by (place, in content) of a page whose markup names its article."""
    seen = _Observer()
    seen.walk(page)
    return seen.roles, seen.tags, seen.places


def fit(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Weights of (kind, name, in content) -> count. A role's log-odds have the prior that its name gives, worth 50 words; a
    place's likewise, within -1 and 1."""
    out = Weights()
    names = {(kind, name) for kind, name, _ in counts}
    for kind, name in names:
        inside, outside = counts.get((kind, name, True), 0), counts.get((kind, name, False), 0)
        if kind == "tag":
            out.tags[name] = -0.05 - 0.5 * outside / (inside + outside)
        elif kind == "place":
            prior = (1 + Weights().word(name)) / 2.2
            out.words[name] = min(1.0, max(-1.0, math.log((inside + 50 * prior) / (outside + 50 * (1 - prior)))))
        elif name not in CONTENT:
            prior = 1 / (1 + math.exp(-Weights().role(name)))
            out.roles[name] = math.log((inside + 50 * prior) / (outside + 50 * (1 - prior)))
    return out


def fitted(pages: DataFrame, page: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most ``sample`` different labelled pages, those of the least hash among pages with an article or main element.

    Only hashes are sorted for that; the pages themselves are fetched by them, one for each hash."""
    labelled = pages.select(F.col(f"`{page}`").alias("html")).filter(F.lower("html").rlike("<(?:article|main)[ >]")).withColumn("h", F.xxhash64("html"))
    last = labelled.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # one row
    if last is None:
        return Weights()
    few = labelled.filter(F.col("h") <= last).groupBy("h").agg(F.first("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("html").to_pylist():
                for kind, counts in zip(("role", "tag", "place"), observe(text), strict=True):
                    seen.update({(kind, *k): v for k, v in counts.items()})
        rows = [(*k, v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["kind", "name", "inside", "n"])

    sums = few.mapInArrow(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return fit({(r["kind"], r["name"], r["inside"]): r["n"] for r in sums.collect()})


def extract(pages: DataFrame, weights: Weights | None = None, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars (code points) of the main text of every page.

    A null or empty page, and one without words, gives an empty text. Rows that repeat are extracted
    each; other columns are left out, whatever their names; null ids are kept; an empty table gives an empty result;
    very long, deeply nested and broken pages take time in proportion to their length. Without ``weights`` they are
    fitted to the pages themselves (``fitted``); without labelled pages names alone decide."""
    weights = weights or fitted(pages, page)
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x, weights) for x in batch.column(page).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, page).mapInArrow(run, schema)
