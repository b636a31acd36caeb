"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import Batches, rows_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[a-zA-Z/][^<]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、—–()\"“”«»]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text, not markup, up to the end tag.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_DROPPED = frozenset(
    "script style title textarea iframe noembed noframes head noscript template svg math canvas object audio video "
    "nav header footer aside form button select option input label fieldset menu dialog datalist".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
#: Deeper elements are placed beside their parent, as browsers do.
_DEEPEST = 256
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_BOXES = frozenset(["div", "section", "ul", "ol", "table", "dl"])
#: What the ratios of a path count if all its text lies in elements named like page furniture.
NAMED_WEIGHT = 0.05
#: End tags that a start tag implies: it closes open elements of these names up to a boundary.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words of class, id and role that hint at page furniture, in the language of web templates.
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|"
    r"footer|foot|sidebar|aside|complementary|contentinfo|widget\w*|related|recommend\w*|share|sharing|social|comments?|"
    r"disqus|respond|reply|replies|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|search|form|pagination|pager|skip|toolbar|hidden)(?=$|[\s_-])"
)


@dataclass
class _Element:
    name: str
    label: str
    up: _Element | None
    dropped: bool
    named: bool  # like page furniture, itself or an element around it
    depth: int
    chosen: bool = False  # holds selected text
    letters: int = 0
    linked: int = 0


@dataclass
class _Text:
    value: str
    inside: _Element
    path: str
    block: int


@dataclass
class _Path:
    letters: int = 0
    marks: int = 0
    nodes: int = 0
    named: int = 0
    sizes: list[int] = field(default_factory=list)


def _value(m: re.Match) -> str:
    return (m[2] or m[3] or m[4] or "").lower()


def _dropped(name: str, attributes: str, up: _Element | None) -> bool:
    """Elements that hold no article by their kind, or that are hidden."""
    if name in _DROPPED:
        # An article's own header holds its title.
        while name == "header" and up is not None:
            if up.name in ("article", "main"):
                return False
            up = up.up
        return True
    if name in ("html", "body", "main", "article") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key == "hidden" or key == "aria-hidden" and _value(m) == "true" or key == "style" and re.search(r"display\s*:\s*none", _value(m)):
            return True
    return False


def _named(name: str, attributes: str, up: _Element | None) -> bool:
    """Elements with a name of page furniture: boxes, not headings and paragraphs; ids in an article name its sections."""
    if not attributes or name in _HEADING or name in ("html", "body", "main", "article", "p"):
        return False
    inside = False
    while up is not None and not inside:
        inside, up = up.name in ("article", "main"), up.up
    keys = ("class", "role") if inside else ("class", "role", "id")
    return any(
        m[1].lower() in keys and _FURNITURE.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", _value(m)))
        for m in _ATTRIBUTE.finditer(attributes)
    )


def _label(name: str, attributes: str) -> str:
    first = next((m for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), None) if attributes else None
    value = (first[2] or first[3] or first[4] or "") if first else ""
    return name + "." + value.split()[0] if value.split() else name


def _texts(page: str) -> list[_Text]:
    """Text nodes outside dropped elements, with their root-to-leaf path and the block they belong to."""
    here = _Element("", "", None, False, False, 0)
    found: list[_Text] = []
    block, at, end = 0, 0, len(page)

    def text(raw: str) -> None:
        if raw and not here.dropped:
            value = html.unescape(raw)
            path = here.label
            found.append(_Text(value, here, path, block))

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3]
        if name not in _INLINE:
            block += 1
        if m[1]:
            up = here
            while up.up is not None and up.name != name:
                up = up.up
            if up.up is not None:
                here = up.up
            continue
        if name == "br":
            text(" ")
        if name in _VOID or (attributes.endswith("/") and name not in _RAW):
            continue
        if name == "p" or name not in _INLINE:  # a block ends an open paragraph and the formatting in it
            up = here
            while up.up is not None and (up.name in _INLINE or up.name == "p"):
                if up.name == "p":
                    here = up.up
                    break
                up = up.up
        if name in _CLOSES:
            names, bounds = _CLOSES[name]
            up = here
            while up.up is not None and up.name not in bounds:
                if up.name in names:
                    here = up.up
                up = up.up
        dropped = here.dropped or _dropped(name, attributes, here)
        named = here.named or _named(name, attributes, here)
        own = _label(name, attributes)
        if here.depth >= _DEEPEST and here.up is not None:
            here = here.up
        here = _Element(name, f"{here.label}/{own}" if here.label else own, here, dropped, named, here.depth + 1)
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                text(page[at:])
                break
            text(page[at : stop.start()])
            at = stop.start()
    return [t for t in found if t.value]


def _smooth(values: list[float], width: int = 2) -> list[float]:
    """Gaussian smoothing over neighbours in page order."""
    kernel = [math.exp(-(k * k) / (2.0 * width)) for k in range(width + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[abs(k)], values[i + k]) for k in range(-width, width + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_paths(texts: list[tuple[str, str, bool]], share: float = 0.5) -> set[str]:
    """Paths whose ratio is high, of (path, text, named) nodes in page order.

    Each path has two ratios: letters a node, and punctuation marks a node, both weighted by the spread
    of its node lengths. They are smoothed in the order in which paths appear, scaled to at most 1, fused
    by their product's root, lowered by the share of the nodes in elements named like page furniture, down to
    :data:`NAMED_WEIGHT`, and kept from ``share`` of the standard deviation of all fused ratios, or a quarter of
    their mean, on.
    """
    paths: dict[str, _Path] = {}
    for path, value, named in texts:
        size = len(value.split())
        if size:
            p = paths.setdefault(path, _Path())
            p.letters += sum(map(len, value.split()))
            p.marks += len(_PUNCTUATION.findall(value))
            p.nodes += 1
            p.named += named
            p.sizes.append(size)
    if not paths:
        return set()

    def scaled(values: list[float]) -> list[float]:
        values = _smooth(values)
        top = max(values)
        return [v / top if top else 0.0 for v in values]

    def spread(p: _Path) -> float:
        mean = sum(p.sizes) / p.nodes
        return 1.0 + math.sqrt(sum((s - mean) ** 2 for s in p.sizes) / p.nodes)

    letters = scaled([p.letters / p.nodes * spread(p) for p in paths.values()])
    marks = scaled([(p.marks + 1) / p.nodes * spread(p) for p in paths.values()])
    names = [1.0 - (1.0 - NAMED_WEIGHT) * p.named / p.nodes for p in paths.values()]
    fused = [math.sqrt(a * b) * c for a, b, c in zip(letters, marks, names, strict=True)]
    mean = sum(fused) / len(fused)
    sigma = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    least = min(max(share * sigma, mean / 4), max(fused))
    return {path for path, f in zip(paths, fused, strict=True) if f >= least}


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, two line ends between them."""
    texts = _texts(page or "")
    selected = content_paths([(t.path, t.value, t.inside.named) for t in texts])
    if not selected:
        return ""

    def above(e: _Element | None) -> Iterator[_Element]:
        while e is not None:
            yield e
            e = e.up

    root: list[_Element] | None = None
    for t in texts:
        size = sum(map(len, t.value.split()))
        link = any(e.name == "a" for e in above(t.inside))
        for e in above(t.inside):
            e.letters += size
            e.linked += size * link
        if t.path in selected and size:
            chain = list(above(t.inside))[::-1]
            for e in chain:
                e.chosen = True
            root = chain if root is None else [a for a, b in zip(root, chain) if a is b]
    top = root[-1] if root else None
    while top is not None and top.up is not None and top.name in _INLINE | {"p"} | _HEADING:
        top = top.up
    kept: dict[int, list[str]] = {}
    for t in texts:
        chain = list(above(t.inside))
        if top is not None and not any(e is top for e in chain):
            continue
        if t.inside.named and t.path not in selected:
            continue
        boxes = [e for e in chain if e.depth > (top.depth if top is not None else 0) and e.name in _BOXES]
        if t.path not in selected and any(
            not e.chosen and (e.name in ("div", "section") or e.linked * 2 > e.letters) for e in boxes
        ):
            continue
        kept.setdefault(t.block, []).append(t.value)
    blocks = (" ".join("".join(parts).split()) for parts in kept.values())
    return "\n\n".join(b for b in blocks if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    out = Batches(schema)
    for page, url, source in rows_of(batches, "page_id", "url", "html"):
        text = main_text(source)
        yield from out.add((page, url, text, len(text)), len(text))
    yield from out.end()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id BIGINT, url STRING, html STRING).

    Pages are independent rows, so nothing is shuffled. Null and empty pages have an empty text, pages without
    tags are one block, cut-off pages end where they end, and repeated rows stay repeated.
    """
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return source.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
