"""Main text of web pages, by the container path that a host's pages agree on.

Each page's containers are scored: a block of text counts for the container it stands in and half for
the one around that (in full, and so on upwards, if that adds unlinked text of its own: a heading or a
lead around the body belongs to the text; loose text outside all containers counts for the page itself), text in links counts against it, and menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments count for nothing. A container is named by its path of tags
and classes, with digits generalised, and known by a key, a digest of its parent's key and its own name, so
that deep nesting costs no more than its depth; what stands within an article is part of it. Spark adds the
scores up by host and path, and the path with the greatest sum (of several the deepest) wins the host. The text of each page is then taken from the containers on its host's winning
path, without the unwanted parts inside; a page that lacks the path uses its own best container.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined
by one space in page order, and nothing is dropped or capped beyond that.

Defined results: a null or empty page has an empty text; a null url counts as the empty host; markup that
is not closed ends with its parent or the page; repeated rows give equal rows; pages of any length are
read whole; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, text_of

#: Winning paths are handed to all tasks while hosts and keys take no more bytes than this; else they are joined.
MOST_BROADCAST_BYTES = 16 << 20
KEY_BYTES = 16
PAGE_KEY = b""

# Kinds of tags and words that name unwanted parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
UNWANTED_TAGS = frozenset("head nav header footer aside form button select menu dialog noscript template iframe object svg canvas".split())
UNWANTED_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toc toolbar widget widgets".split())
#: Words that may stand beside an unwanted one in a class or id: site-footer is a footer, social-impact is a subject.
LAYOUT_WORDS = frozenset("area bar block bottom box container content foot form global head inner item left link links list main outer page panel post primary right row secondary section site sub top unit wrap wrapper".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figure figcaption".split())
#: Words that mark a part as unwanted whatever stands beside them, unless a word says that it only tells of a state.
DECISIVE_WORDS = frozenset("comment comments commentlist cookie cookies disqus".split())
STATE_WORDS = frozenset("allow allowed closed count disabled enabled has no off open with without".split())
#: The page itself has no tag.
WIDE = frozenset(["", "html", "body", "main"])
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
CLOSED_BY = {"p": frozenset("p div article section ul ol li table h1 h2 h3 h4 h5 h6 blockquote pre form hr main aside nav header footer dl figure".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile("[a-z0-9]+")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/?#]*://([^/?#]*)", 1))


class Containers:
    """The containers of a page by number, in the order in which they open; 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.tag, self.key, self.depth = [0], [""], [PAGE_KEY], [0]

    def add(self, parent: int, tag: str, name: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.key.append(_key(self.key[parent], name))
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


def _key(parent: bytes, name: str) -> bytes:
    return hashlib.blake2b(parent + name.encode("utf-8", "replace"), digest_size=KEY_BYTES).digest()


def path_key(path: str) -> bytes:
    """The key of a path of names, like /html/body/div.post."""
    return functools.reduce(_key, path.strip("/").split("/"), PAGE_KEY)


class _Open:
    """An element that is not yet closed; block is the innermost tag here that a following tag may close, past inline ones."""

    __slots__ = ("tag", "container", "unwanted", "link", "block")

    def __init__(self, tag: str, container: int, unwanted: bool, link: bool, block: str) -> None:
        self.tag, self.container, self.unwanted, self.link, self.block = tag, container, unwanted, link, block


def texts_of(page: str) -> tuple[Containers, list[tuple[int | None, bool, str]]]:
    """The containers, and (the innermost container, whether in a link, text) in page order; (None, False, "") between blocks."""
    found, pieces = Containers(), []
    stack, n_open = [_Open("", 0, False, False, "")], Counter()
    between = (None, False, "")

    def pop() -> str:
        tag = stack.pop().tag
        n_open[tag] -= 1
        return tag

    for token in _TOKEN.finditer(page):
        name = token.group(3)
        if name is None:
            if token.group(1):
                pieces.append(between)
            elif (text := token.group())[0] != "<" or text == "<":
                top = stack[-1]
                if not top.unwanted:
                    pieces.append((top.container, top.link, text))
            continue
        name, closing, rest = name.lower(), token.group(2), token.group(4)
        if name not in INLINE:
            pieces.append(between)
        if closing:
            if n_open[name]:
                while pop() != name:
                    pass
            continue
        if name in VOID:
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].block, ()):
            while pop() not in CLOSED_BY:
                pass
        top = stack[-1]
        within = found.tag[top.container]
        label, unwanted = name, top.unwanted or name in UNWANTED_TAGS
        if rest and not rest.isspace():
            for match in _ATTRIBUTE.finditer(rest):
                kind, value = match.group(1).lower(), (match.group(2) or match.group(3) or match.group(4) or "").lower()
                if kind == "hidden" or kind == "aria-hidden" and value == "true":
                    unwanted = True
                elif kind == "role":
                    unwanted = unwanted or value in UNWANTED_ROLES
                elif kind == "class" or kind == "id" and not (within == "article" and name in TEXT_TAGS):
                    if name not in WIDE and (name != "article" or within == "article"):
                        unwanted = unwanted or any(map(_names_unwanted, value.split())) or name not in INLINE and name not in RUNNING and any(map(_is_decisive, value.split()))
                if kind == "class":
                    label += "".join("." + re.sub(r"\d+", "N", part) for part in sorted(value.split()))
        if not rest.endswith("/"):
            own = found.add(top.container, name, label) if name in CONTAINERS and not _is_whole(within, name) else top.container
            stack.append(_Open(name, own, unwanted, top.link or name == "a", top.block if name in INLINE else name))
            n_open[name] += 1
    return found, pieces


def _names_unwanted(token: str) -> bool:
    """Whether a class or an id is an unwanted word, alone or beside words of layout."""
    words = _WORDS.findall(token)
    return not UNWANTED_WORDS.isdisjoint(words) and all(word in UNWANTED_WORDS or word in LAYOUT_WORDS or word.isdigit() for word in words)


def _is_decisive(token: str) -> bool:
    """Whether a class or an id names readers' comments or a notice on cookies; comments-open tells of a state."""
    words = _WORDS.findall(token)
    return not DECISIVE_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words)


def _is_whole(within: str, name: str) -> bool:
    """Whether a container is no more than a part of the one around it: all of an article's, and of a main part all but articles."""
    return within == "article" or within == "main" and name != "article"


def container_scores(found: Containers, pieces: list[tuple[int | None, bool, str]]) -> dict[int, int]:
    """Score of each container of a page."""
    # containers on one path count together
    first: dict[bytes, int] = {}
    same = [first.setdefault(key, number) for number, key in enumerate(found.key)]
    scores: dict[int, int] = defaultdict(int)
    plain: dict[int, int] = defaultdict(int)
    for container, link, text in pieces:
        if container is not None and (size := len(text.strip())):
            scores[same[container]] += -2 * size if link else 2 * size
            if not link:
                plain[same[container]] += size
    adds = {one for one, score in scores.items() if score > 0 and found.tag[one] not in WIDE}
    # a container opens after the one around it, so that what it carries on is complete by its turn
    for one in range(len(found.key) - 1, 0, -1):
        size, around = plain.get(one, 0), same[found.parent[one]]
        if size:
            scores[around] += 2 * size if around in adds else size
            if around in adds:
                plain[around] += size
    return {one: score for one, score in scores.items() if score > 0}


def text_at(page: str, winner: bytes | None) -> str:
    """The text in a page's containers on the path of key `winner`, or in its own best container if it has none there."""
    found, pieces = texts_of(page)
    text = _text_in(found, pieces, winner)
    if not text:
        scores = container_scores(found, pieces)
        if scores:
            best = min(scores, key=lambda one: (-scores[one], found.depth[one], found.key[one]))
            text = _text_in(found, pieces, found.key[best])
    return text


def _text_in(found: Containers, pieces: list[tuple[int | None, bool, str]], winner: bytes | None) -> str:
    inside = [winner == found.key[0]]
    for parent, key in zip(found.parent[1:], found.key[1:]):
        inside.append(inside[parent] or key == winner)
    joined = "".join("\n" if container is None else html.unescape(text) for container, _, text in pieces if container is None or inside[container])
    return " ".join(joined.split())


def _score_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        totals: dict[tuple[str, int, bytes], int] = defaultdict(int)
        for host, page in zip(rows["host"].to_pylist(), rows["html"]):
            found, pieces = texts_of(page.as_py())
            for one, score in container_scores(found, pieces).items():
                totals[host, found.depth[one], found.key[one]] += score
        columns = [*zip(*totals)] or [()] * 3
        kinds = pa.string(), pa.int32(), pa.binary()
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(totals.values(), pa.int64())], ["host", "depth", "path", "score"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winner): for each host the key of the path with the greatest sum of scores."""
    votes = pages.select(host_of(F.col("url")).alias("host"), text_of("html").alias("html")).mapInArrow(_score_pages, "host string, depth int, path binary, score long")
    by_path = votes.groupBy("host", "depth", "path").agg(F.sum("score").alias("score"))
    return by_path.groupBy("host").agg(F.max(F.struct("score", "depth", "path")).getField("path").alias("winner"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        texts = [text_at(page.as_py(), winner) for page, winner in zip(rows["html"], rows["winner"].to_pylist())]
        yield pa.RecordBatch.from_arrays([rows["page_id"], rows["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """Per page: page_id, url, text and n_chars (see the module's docstring)."""
    winners = durable(winning_paths(pages))
    small = (winners.agg(F.sum(F.octet_length("host") + KEY_BYTES)).first()[0] or 0) <= most_bytes
    named = pages.select(F.col("page_id").cast("long"), "url", text_of("html").alias("html"), host_of(F.col("url")).alias("host"))
    joined = named.join(F.broadcast(winners) if small else winners, "host", "left")
    return joined.select("page_id", "url", "html", "winner").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
