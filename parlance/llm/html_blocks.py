"""HTML to a sequence of text blocks with their tag paths, and the vectors a labeller reads."""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

import numpy as np

#: Elements whose content is raw text, not markup, and never text of the page; all others are left to the labeller.
RAW = frozenset("script style textarea iframe noembed noframes".split())
#: Innermost open elements that a block's path keeps, and that end tags left out are looked for among: a page may nest without end.
DEPTH = 64
# One scan from left to right: a tag, once begun, ends at the first > outside a quoted value or at the end of the page. A quote has a meaning only where a value begins.
# Nothing is tried twice (possessive quantifiers), so a page takes time in proportion to its length whatever is in it.
_MARKUP = re.compile(
    r"""<(?:(!--)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)"""
    r"""((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+|(?=>)))?+)*+)(?:>|\Z))"""
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
#: Fixed tag groups of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",), "option": ("option",), "button": ("button",)}

PATH, LEAF, WORDS, NUMBERS = 96, 32, 24, 8
WIDTH = PATH + LEAF + WORDS + NUMBERS


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _after_comment(page: str, at: int) -> int:
    """Place behind the comment whose text begins at `at`; one that never ends takes the rest of the page."""
    for short in (">", "->"):
        if page.startswith(short, at):
            return at + len(short)
    end = _COMMENT_END.search(page, at)
    return end.end() if end else len(page)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: path is ((tag, name tokens), ...), the innermost DEPTH of them; linked counts characters inside links."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    open_: dict[str, int] = {}  # open elements by tag
    pieces: list[str] = []
    link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, tuple(stack[-DEPTH:]), linked))
            pieces.clear()
        linked = 0

    def cut(i: int) -> None:
        for tag, _ in stack[i:]:
            open_[tag] -= 1
        del stack[i:]

    def close(names) -> None:
        if not any(open_.get(n) for n in names):
            return
        for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
            if stack[i][0] in names:
                cut(i)
                return
            if stack[i][0] in ("table", "ul", "ol", "article", "section", "div", "body") and names != (stack[i][0],):
                return

    at = 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        if m[1]:
            at = _after_comment(page, at)
            continue
        if m[3] is None:  # declarations and instructions
            continue
        end, tag, attrs = m[2], m[3].lower(), m[4]
        if tag in RAW and not end:
            found = _RAW_END[tag].search(page, at)
            at = found.start() if found else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                link = not end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW or tag in ("img", "input", "wbr", "embed") or (tag in ("svg", "math") and attrs.endswith("/")):
            continue
        flush()
        link = False
        if tag in VOID:
            continue
        if end:
            if open_.get(tag):
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in _CLOSES_P:
            close(("p",))
        if tag in _CLOSES_SAME:
            close(_CLOSES_SAME[tag])
        names = tuple(w for g in _NAMES.findall(attrs) for x in g if x for w in _PARTS.findall(x.lower())) if attrs else ()
        if not attrs.endswith("/"):
            stack.append((tag, names))
            open_[tag] = open_.get(tag, 0) + 1
    pieces.append(page[at:])
    flush()
    return out


@lru_cache(maxsize=1 << 17)
def _bucket(token: str, n: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % n, 1.0 if (h >> 16) & 1 else -1.0


class _WordBuckets(dict):
    """Word -> one of 2 * WORDS cells, the second half negative; forgets everything when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        i, s = _bucket(word, WORDS)
        self[word] = i if s > 0 else i + WORDS
        return self[word]


_WORD_BUCKETS = _WordBuckets()


@lru_cache(maxsize=1 << 14)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH + LEAF, np.float32)
    for depth, (tag, names) in enumerate(reversed(path)):
        for token in (f"<{tag}>", *names):
            i, s = _bucket(token, PATH)
            v[i] += s
            if depth == 0:
                i, s = _bucket(token, LEAF)
                v[PATH + i] += s
    return np.clip(v, -2, 2)


def vectors(found: list[Block]) -> np.ndarray:
    """One row per block: hashed path tokens, hashed words, and a few numbers."""
    x = np.zeros((len(found), WIDTH), np.float32)
    for i, b in enumerate(found):
        x[i, : PATH + LEAF] = _path_vector(b.path)
        words = b.text.lower().split()
        n = len(b.text)
        cells = np.bincount([_WORD_BUCKETS[w] for w in words], minlength=2 * WORDS)
        x[i, PATH + LEAF : PATH + LEAF + WORDS] = np.clip((cells[:WORDS] - cells[WORDS:]) / (len(words) ** 0.5 * 2), -1.5, 1.5)
        x[i, -NUMBERS:] = (np.log1p(n) / 6, min(1.0, b.linked / n), np.log1p(sum(map(b.text.count, ".,;:"))) / 3, b.text[-1] in ".!?", len(b.path) / 8, i / len(found), "©" in b.text, len(words) == 1)
    return x
