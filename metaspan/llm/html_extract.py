"""Main text of HTML pages by equivalence-class template deduction, beside what tags and telling names say.

A page is a sequence of tokens: tags, told apart by the path of block tags they stand in, and text. For each host,
tokens whose occurrence vectors over its pages are equal form a class; the vector is represented by the number
of pages and a sum of hashes of (page, count), which adds up in any order, so no host's pages are ever
collected. Classes that enough pages support and that nest, all their paths inside paths of valid classes, are the
template. Its paths are the slots; a text block belongs to the deepest slot around it. Slots that are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments by their tags and names (names
of html, body, main, article and of elements with most of the host's text say nothing), or by what they hold over the host (outside articles mostly links; anywhere, the same text on nearly every page), are
template; of a class with links, boxes without other text close as a whole. The rest is extracted, or of a page most of
whose text is in one article element only that; by the host's template, elements that stand several times on a page,
say the same everywhere or hold little of the host's text are cards and no such article.

Defined results: null or empty html, and pages without such text, give the empty string; a null url is the host
''; hosts with one page have a template of that page; malformed markup is read as far as it goes; repeated
rows each get a row and count as pages each; an empty table gives none; other columns are ignored whatever their names. Texts are neither
dropped for being short nor capped.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .url_filter import host_of

#: Pages that must support a class: this share of the host's pages, two at least if it has two.
SUPPORT = 0.05
#: Share of linked text that makes a menu, share of pages with one text that makes a notice.
LINKED, CONSTANT = 0.6, 0.9
#: Levels of a path that are always told apart.
DEEPEST = 48

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(script|style|noscript|template|textarea|svg|iframe|select|object)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that do not end a block.
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_NEVER = frozenset("nav header footer aside form head title button dialog menu fieldset figcaption".split()) - {"figcaption"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|sidebar|side|comments?|respond|replies|menu|nav\w*|breadcrumbs?|footer|header|masthead|"
    r"share|sharing|social|related|recommended|newsletter|subscri\w+|widget|login|signup|popup|modal|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
#: Names of readers' comments; names that tell what a layout has; tags around whole pages and stories, whose names are not those of parts.
_READERS = re.compile(r"comments?|respond|replies", re.I)
_LAYOUT = re.compile(r"(?<![^\s_-])(?:has|have|no|with|without|hide|show)[_-][\w-]+", re.I)
_WHOLE = frozenset({"html", "body", "main", "article"})
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_OPENS_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def blocks(page: str) -> Iterator[tuple[str, str, int]]:
    """(path of block tags, white-space-normalised text, characters of it inside links) of each text block, in page order.

    A block tag without text gives its path with an empty text when it opens.
    """
    stack: list[tuple[str, str]] = []  # tag, path up to it
    words: list[str] = []
    linked = links = 0

    def path() -> str:
        return stack[-1][1] if stack else ""

    def flush() -> Iterator[tuple[str, str, int]]:
        nonlocal linked
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            yield path(), text, min(linked, len(text))
        linked = 0

    def close(tags: set[str], stop: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = entities.unescape(page[at : m.start()])
            words.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ends = bool(m[2] or m[5])
        if tag == "a":
            links = 0 if ends else 1
        if tag in _INLINE:
            if tag == "br":
                words.append(" ")
            continue
        yield from flush()
        if tag in _VOID:
            continue
        if ends:
            close({tag})
            links = 0
            continue
        if tag in _CLOSES:
            close(_CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "div", "section", "article"}))
        elif tag in _OPENS_BLOCK:
            close({"p"}, frozenset({"div", "section", "article", "td", "li", "body", "blockquote"}))
        names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[4] or m[7] or "")}
        mark = "".join(f"[{k}={' '.join(names[k].split()).lower().replace('/', '|')}]" for k in ("role", "id", "class") if names.get(k))
        above, step = path(), f"/{tag}{mark}"
        # Far down a path grows only by what decides: so deep nesting stays linear.
        grows = len(stack) < DEEPEST or (is_template(step) and not is_template(above)) or (is_article(step) and not is_article(above))
        stack.append((tag, above + step if grows else above))
        if grows:
            yield path(), "", 0
    words.append(entities.unescape(page[at:]))
    yield from flush()


def _steps(path: str) -> Iterator[tuple[str, bool, str]]:
    """Tag, whether its tag or role is that of a template, and the name that says so, of each step of a path."""
    for step in path.split("/")[1:]:
        tag, _, marks = step.partition("[")
        never, name = tag in _NEVER, ""
        for mark in marks.rstrip("]").split("]["):
            key, _, value = mark.partition("=")
            if tag in _WHOLE:
                continue
            never = never or key == "role" and value in _ROLES
            if not name and key in ("id", "class"):
                found = _NAMED.search(_LAYOUT.sub(" ", value))
                name = found[1].lower() if found else ""
        yield tag, never, name


def is_template(path: str, holding: frozenset[str] = frozenset()) -> bool:
    """Whether a path is in a menu, header, footer, sidebar, notice, advert, form or comment by its tags and names; those of ``holding`` are not, by their names."""
    at = ""
    for step, (_, never, name) in zip(path.split("/")[1:], _steps(path)):
        at = f"{at}/{step}"
        if never or name and at not in holding:
            return True
    return False


def _wrappers(path: str) -> list[str]:
    """The named elements around a path that would hold the main text if they hold most text: none in a template's tag, none of readers' comments."""
    at, out = "", []
    for step, (_, never, name) in zip(path.split("/")[1:], _steps(path)):
        at = f"{at}/{step}"
        if never or name and _READERS.match(name):
            return []
        if name:
            out.append(at)
    return out


def article_of(path: str) -> str:
    """The outermost article or main element around a path, or nothing."""
    at = ""
    for step in path.split("/")[1:]:
        at = f"{at}/{step}"
        if step.partition("[")[0] in ("article", "main") or "[role=main]" in step:
            return at
    return ""


def is_article(path: str) -> bool:
    return bool(article_of(path))


#: What _tally() makes per path: name, how two of them become one.
_SUMS = {"pages": add, "v1": add, "v2": add, "chars": add, "linked": add, "least": min, "greatest": max, "plain": add, "inside": add, "n": add}
_MERGE = tuple(_SUMS.values())


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and path, over a batch: pages, hashes of the occurrence vector, characters, linked characters, least and greatest hash of a page's texts, characters outside template tags and comments, characters inside it if it is named or an article, occurrences."""
    for batch in batches:
        sums: dict[tuple[str, str], list[int]] = {}
        around: dict[str, tuple[bool, set[str]]] = {}
        for host, page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), frames.texts(batch.column(2))):
            page = page.as_py()
            if not page:
                continue
            counts, chars, linked, inside, said = Counter(), Counter(), Counter(), Counter(), {}
            for path, text, links in blocks(page):
                if not text:
                    counts[path] += 1
                    continue
                chars[path] += len(text)
                linked[path] += links
                said[path] = zlib.crc32(text.encode(), said.get(path, 0))
                if path not in around:
                    if len(around) > 20_000:
                        around.clear()
                    around[path] = any(never or _READERS.match(name) for _, never, name in _steps(path)), {*_wrappers(path), article_of(path)} - {""}
                for box in around[path][1]:
                    inside[box] += len(text)
            for path, n in counts.items():
                h = xxhash.xxh64_intdigest(f"{page_id}:{n}")
                text = said.get(path, 0)
                new = (1, h >> 33, h & 0x7FFFFFFF, chars[path], linked[path], text, text, 0 if path in chars and around[path][0] else chars[path], inside[path], n)
                old = sums.get((host, path))
                sums[host, path] = [f(a, b) for f, a, b in zip(_MERGE, old, new)] if old else list(new)
        keys = list(sums)
        for at in range(0, len(keys), 20_000):
            own = keys[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.string()), *(pa.array([sums[k][i] for k in own], pa.int64()) for i in range(10))],
                names=["host", "path", *_SUMS],
            )


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, slots, closed, holding, cards): paths of each host's valid classes, those of them that its statistics mark as template, named elements that hold most text, article elements that hold no story."""
    tallied = pages.mapInArrow(frames.tidy(_tally), f"host string, path string, {', '.join(f'{c} long' for c in _SUMS)}")
    whole = {add: F.sum, min: F.min, max: F.max}
    paths = tallied.groupBy("host", "path").agg(*[whole[f](c).alias(c) for c, f in _SUMS.items()])
    sizes = paths.groupBy("host").agg(F.max("pages").alias("most"), F.sum("plain").alias("whole"))
    # the commonest path (the root) is on every page of its host
    supported = paths.join(sizes, "host").where(F.col("pages") >= F.greatest(F.least(F.lit(2), F.col("most")), F.ceil(F.col("most") * SUPPORT)))
    # least and greatest, not sums of squares, which exceed 64 bits at some 32,768 pages of a host
    same = (F.col("least") == F.col("greatest")) & (F.col("least") > 0)
    # at most 1 / SUPPORT times a page's tokens are supported, so a host's template is small
    member = F.struct("path", "pages", "v1", "v2", "chars", "linked", same.alias("same"), (2 * F.col("inside") > F.col("whole")).alias("holds"), (F.col("n") == F.col("pages")).alias("once"))
    members = supported.groupBy("host").agg(F.collect_list(member).alias("members"), F.max("most").alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template([Member(**m) for m in own], most) for own, most in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([sorted(f[i]) for f in found], pa.list_(pa.string())) for i in range(4))], names=["host", "slots", "closed", "holding", "cards"])

    return members.mapInArrow(frames.tidy(run), "host string, slots array<string>, closed array<string>, holding array<string>, cards array<string>")


@dataclass(frozen=True)
class Member:
    """A path's sums over its host; (pages, v1, v2) stands for its occurrence vector."""

    path: str
    pages: int
    v1: int
    v2: int
    chars: int
    linked: int
    same: bool
    holds: bool = False
    once: bool = True

    @property
    def vector(self) -> tuple[int, int, int]:
        return self.pages, self.v1, self.v2


def _above(path: str) -> str:
    return path.rpartition("/")[0]


def template(members: list[Member], most: int) -> tuple[set[str], set[str], set[str], set[str]]:
    """Slots of the valid classes of a host with ``most`` pages, those of them that are closed, named elements that hold most of its text, and articles that are not its pages' stories."""
    holding = frozenset(m.path for m in members if m.holds)
    classes: dict[tuple[int, int, int], list[str]] = {}
    for m in members:
        classes.setdefault(m.vector, []).append(m.path)
    slots, before = {m.path for m in members}, -1
    while len(slots) != before:
        before = len(slots)
        for own in classes.values():
            if any(_above(p) and _above(p) not in slots for p in own):
                slots.difference_update(own)
    texts = {m.path: m for m in members if m.path in slots and m.chars and not is_template(m.path, holding)}
    varying = {article_of(p) for p, m in texts.items() if not m.same or m.pages < 2}
    cards = {m.path for m in members if article_of(m.path) == m.path and not (m.once and m.holds and m.path in varying)}
    # supported slots of hosts with more than a page are on two pages at least
    menus = {p for p, m in texts.items() if m.pages >= 2 and m.linked >= LINKED * m.chars and not is_article(p)}
    said = sum(m.chars for p, m in texts.items() if is_article(p))
    # an article's title, and what holds most of the articles' text, are not notices: pages may be copies
    fixed = {p for p, m in texts.items() if m.pages >= 2 and m.same and not (is_article(p) and (2 * m.chars > said or re.search(r"/h1(?:\[[^/]*)?$", p)))}
    common = {p for p in fixed if texts[p].pages >= CONSTANT * most}
    if all(m.same for m in texts.values()):
        # nothing tells the pages from each other
        return slots, set(menus), set(holding), cards
    closed = menus | common
    # a box of one class, all of whose text is fixed or linked, closes whole if it holds a menu
    open_, linked = Counter(), Counter()
    for p in texts:
        box = p
        while box:
            open_[box] += p not in fixed and p not in menus
            linked[box] += p in menus
            box = _above(box)
    vectors = {m.path: m.vector for m in members}
    for p in fixed - closed:
        box = p
        while box and vectors.get(box) == vectors[p] and not open_[box]:
            if linked[box]:
                closed.add(p)
                break
            box = _above(box)
    return slots, closed, set(holding), cards


def extract(page: str, slots: frozenset[str], closed: frozenset[str], holding: frozenset[str] = frozenset(), cards: frozenset[str] = frozenset()) -> str:
    """The page's main text by its host's template."""
    known: dict[str, tuple[bool, str]] = {}
    kept: list[tuple[str, str]] = []
    stories: Counter[str] = Counter()
    for path, text, _ in blocks(page):
        if path not in known:
            slot = path
            while slot and slot not in slots:
                slot = _above(slot)
            known[path] = not is_template(path, holding) and slot not in closed, article_of(path)
        keep, article = known[path]
        if keep and not text and path == article:
            stories[path] += 1
        elif keep and text:
            kept.append((article, text))
    story = next(iter(own)) if len(own := {a: n for a, n in stories.items() if a not in cards}) == 1 and set(own.values()) == {1} else ""
    if story and 2 * sum(len(t) for a, t in kept if a == story) > sum(len(t) for _, t in kept):
        kept = [(a, t) for a, t in kept if a == story]
    return "\n\n".join(t for _, t in kept)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    pages = df.select(host_of(df[url_col]).alias("host"), df[id_col].cast("long").alias("page_id"), df[url_col].alias("url"), df[html_col].alias("html"))
    templates = frames.written(deduce_templates(pages.select("host", "page_id", "html")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple[frozenset[str], ...]] = {}
        for batch in batches:
            out = []
            for i, (host, page) in enumerate(zip(batch.column(0).to_pylist(), frames.texts(batch.column(3)))):
                if host not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[host] = tuple(frozenset(batch.column(k)[i].as_py() or []) for k in (4, 5, 6, 7))
                out.append(extract(page.as_py(), *ready[host]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return frames.join_by_size(pages, templates, "host", "left").select("host", "page_id", "url", "html", "slots", "closed", "holding", "cards").mapInArrow(frames.tidy(run), "page_id long, url string, text string, n_chars long")
