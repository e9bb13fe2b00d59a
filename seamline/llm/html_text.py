"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi.

A leaf block is the text between two block-level tags; inline tags don't divide it. Its features are the tags around it,
the words of their class and id attributes, and what its text looks like. The field has two labels, main text and
other, with transition weights, and is trained by gradient steps on labelled pages: a bounded set of (html, text) rows, by
default pages that this module generates from common page layouts.

Scripts, styles, comments and other raw elements are no blocks; drawings, selections and what stands in for scripts or
objects are skipped as far as the element reaches, which is nothing if it closes itself. Character references are decoded once, white space
inside a block becomes one space, and the main blocks are joined in page order by one space.

Defined results: a null or empty html, or one without text, gives an empty text; very long pages are read whole, a batch
of them at a time; of two pages that differ only in what is skipped the texts are equal; broken markup is read as far as tags can
be told; a "<" that begins no tag is text; repeated rows give equal texts; an empty table gives an empty result; other
columns stay, but text and n_chars are replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.shingles import byte_slices

#: The field is fitted on at most so many labelled pages.
MAX_LABELLED = 2_000
GENERATED = 700

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open tag of the second kind.
ENDS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAGS = frozenset("nav header footer aside form article main section table figure figcaption ul ol li p div h1 h2 h3 h4 h5 h6 button blockquote pre dl dt dd td th body address menu fieldset dialog details".split())
NAME_PARTS = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar",
    "side": "sidebar side widget widgets related rail recommended popular trending",
    "foot": "footer foot copyright legal",
    "head": "header masthead banner site logo",
    "note": "cookie cookies consent notice alert gdpr popup modal overlay disclaimer",
    "talk": "comment comments reply replies respond discussion disqus",
    "ask": "newsletter subscribe signup login search form share social",
    "body": "content article post entry story main text body prose",
}
#: Elements of markup whose text is none of the page's. One that is never closed ends with the element around it.
SKIPPED = frozenset("noscript template svg select object canvas".split())
PART_OF = {word: part for part, words in NAME_PARTS.items() for word in words.split()}

#: What begins markup at a "<": a comment's start, a raw element's, a declaration's, or a tag's name.
_BEGINS = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<raw>script|style|iframe|textarea|title)(?=[\s/>])|(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*))", re.IGNORECASE)
#: A tag's attributes: whatever stands in quotes, or isn't a quote or the tag's end. Nothing is tried twice.
_ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">])*+""")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in "script style iframe textarea title".split()}
_LONG_REFERENCE = re.compile(r"&#(?:0*+[0-9]{8,}|[xX]0*+[0-9a-fA-F]{7,});?")


def tags_of(page: str, raw_may_be_empty: Callable[[], bool] = lambda: False) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of a page's tags, from left to right; name is empty for comments
    and declarations, and raw elements are one piece each, named raw. In drawings raw elements that close themselves are empty.

    Nothing is looked for again where it was once not found: without a further ">" the rest is text, and after a quote
    that is never closed quotes no longer count. So the time is in proportion to the page, whatever is in it.
    """
    at, quotes = 0, True
    while (at := page.find("<", at)) >= 0:
        m = _BEGINS.match(page, at)
        if m is None:
            at += 1
            continue
        if m["comment"]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        near = page.find(">", m.end())
        if near < 0:
            # the rest of the page has no tag's end; raw text and comments apart, it is text
            rest = page.find("<!--", at)
            if rest >= 0:
                yield rest, len(page), "", False, ""
            return
        if m["other"]:
            yield at, near + 1, "", False, ""
            at = near + 1
            continue
        end = near
        if quotes:
            full = _ATTRIBUTES.match(page, m.end()).end()
            if full < len(page) and page[full] == ">":
                end = full
            else:
                quotes = False
        more = page[m.end() : end]
        if m["raw"]:
            raw = m["raw"].lower()
            if more.endswith("/") and raw_may_be_empty():
                last = end + 1
            else:
                closing = _RAW_ENDS[raw].search(page, end + 1)
                last = closing.end() if closing else len(page)
            yield at, last, "raw", False, ""
            at = last
            continue
        yield at, end + 1, m["name"].lower(), bool(m["end"]), more
        at = end + 1


def unescaped(text: str) -> str:
    """Character references decoded once; numbers beyond any character are U+FFFD, however long."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_REFERENCE.sub("�", text) if "&#" in text else text)


_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)


class _Node:
    """An open tag: its name, the features that it and the tags around it give, whether its text is skipped, and the place
    in the stack of the nearest tag that a paragraph can't reach over."""

    __slots__ = ("barrier", "features", "name", "skip")

    def __init__(self, name: str, features: frozenset[str], skip: bool, barrier: int):
        self.name, self.features, self.skip, self.barrier = name, features, skip, barrier


#: A word of a class that says what there is beside the element, not what it is: "with-sidebar".
_BESIDE = re.compile(r"\b(?:with|has|no|without|left|right)[-_]+\w+|\b\w+[-_](?:left|right|fixed|sticky|visible|hidden|on|off|dark|light)\b")
#: Tags that say themselves what part of a page they are.
PART_TAGS = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "ask", "article": "body", "main": "body", "dialog": "note"}


def _own_features(name: str, more: str) -> tuple[set[str], str | None]:
    """The features of a tag, and the part of a page that it names, if any.

    A name of main text beside others wins, as in "main-content with-sidebar"; the names of the whole page's element say nothing.
    """
    found, parts = {"tag=" + name} if name in TAGS else set(), []
    if more and name not in ("body", "html"):
        for groups in _NAMED.findall(more):
            words = _BESIDE.sub(" ", "".join(groups).lower())
            parts += [PART_OF[w] for w in re.split(r"[^a-z0-9]+", words) if w in PART_OF]
    if "body" in parts:
        parts = ["body"]
    found |= {"part=" + p for p in parts}
    return found, parts[0] if parts else PART_TAGS.get(name)


def blocks_of(page: str) -> list[tuple[str, frozenset[str], int]]:
    """(text, features of the tags around it, characters inside links) of a page's leaf blocks."""
    root = _Node("", frozenset(), False, 0)
    stack, out = [root], []
    opened: dict[str, int] = {}  # open tags by name: an end without a beginning costs nothing
    pieces: list[str] = []
    links, in_link, around = 0, 0, root
    cache: dict[tuple, frozenset[str]] = {}

    def close() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, around.features, links))
            pieces.clear()
        links = 0

    def cut(k: int) -> None:
        for node in stack[k:]:
            opened[node.name] -= 1
        del stack[k:]

    def text(piece: str) -> None:
        nonlocal around, links
        if stack[-1].skip:
            return
        if not pieces:
            if not piece.strip():
                return
            around = stack[-1]
        pieces.append(unescaped(piece))  # a reference doesn't reach over tags
        if in_link:
            links += len(piece)

    at = 0
    for start, end, name, ends, more in tags_of(page, lambda: stack[-1].skip):
        if start > at:
            text(page[at:start])
        at = end
        if not name:
            continue
        if name == "raw":
            close()
            continue
        if name in INLINE:
            if name == "a" and not stack[-1].skip:
                in_link = 0 if ends else 1
            continue
        close()
        if name not in SKIPPED and not stack[-1].skip:
            in_link = 0
        if ends:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                cut(k)
            continue
        if name in ENDS_PARAGRAPH and stack[stack[-1].barrier].name == "p" and not stack[-1].skip:
            cut(stack[-1].barrier)
        if name in ENDS and stack[-1].name in (name, ENDS[name]):
            cut(len(stack) - 1)
        if name in VOID or more.endswith("/"):
            continue
        top = stack[-1]
        key = (top.features, name, more)
        if key not in cache:
            own, part = _own_features(name, more)
            kept = top.features if part is None else frozenset(f for f in top.features if not f.startswith("near="))
            cache[key] = kept | own | ({"near=" + part} if part else set())
        skip = top.skip or name in SKIPPED
        opened[name] = opened.get(name, 0) + 1
        stack.append(_Node(name, cache[key], skip, len(stack) if name in ENDS_PARAGRAPH or skip else top.barrier))
    if at < len(page):
        text(page[at:])
    close()
    return out


def features_of(blocks: list[tuple[str, frozenset[str], int]]) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    for k, (text, around, links) in enumerate(blocks):
        n = len(text)
        words = text.count(" ") + 1
        own = [*around, "bias", f"words={min(int(np.log2(words)), 7)}", f"links={min(4, round(4 * links / n))}", f"first={min(k, 3)}", f"last={min(len(blocks) - 1 - k, 3)}"]
        if text[-1] in ".!?:\"')”»":
            own.append("ends")
        if len(blocks) < 4:
            own.append(f"of={len(blocks)}")
        if "©" in text or "copyright" in text[:60].lower():
            own.append("rights")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights: (features, 2) for the labels, (2, 2) for transitions, (2,) for the first block. Label 1 is main text."""

    index: dict[str, int]
    state: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, pages: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(pages, longest, 2) label scores, padded, and each page's length."""
        length = np.array([len(p) for p in pages])
        out = np.zeros((len(pages), max(1, length.max(initial=1)), 2))
        ids, heads = [], []
        for page in pages:
            for block in page:
                heads.append(len(ids))
                ids += [self.index[f] for f in block if f in self.index]
                if heads[-1] == len(ids):
                    ids.append(self.index["bias"])
        if ids:
            row = np.repeat(np.arange(len(pages)), length)
            column = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            out[row, column] = np.add.reduceat(self.state[ids], heads, axis=0)
        return out, length

    def viterbi(self, pages: list[list[list[str]]]) -> list[np.ndarray]:
        """The best label sequence of each page; pages are decoded side by side."""
        scores, length = self.scores(pages)
        steps = scores.shape[1]
        best = scores[:, 0] + self.start
        back = np.zeros((steps, len(pages), 2), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.move[None]
            back[t] = ways.argmax(1)
            further = ways.max(1) + scores[:, t]
            best = np.where((t < length)[:, None], further, best)
        labels = np.zeros((len(pages), steps), np.int8)
        at = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            labels[:, t] = at
            at = np.where(t < length, back[t][np.arange(len(pages)), at], at) if t else at
        return [row[:n] for row, n in zip(labels, length)]


def _log_add(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(labelled: list[tuple[list[list[str]], list[int]]], steps: int = 80, rate: float = 0.4, decay: float = 1e-3) -> Field:
    """Gradient ascent on the conditional likelihood, all pages at once: forward and backward sums over padded sequences."""
    labelled = [(f, y) for f, y in labelled if f]
    names = sorted({n for page, _ in labelled for block in page for n in block} | {"bias"})
    field = Field({n: k for k, n in enumerate(names)}, np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2))
    if not labelled:
        return field
    pages = [p for p, _ in labelled]
    length = np.array([len(p) for p in pages])
    n, steps_in = len(pages), int(length.max())
    row = np.repeat(np.arange(n), length)
    column = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    gold = np.zeros((n, steps_in), int)
    gold[row, column] = [y for _, labels in labelled for y in labels]
    inside = np.arange(steps_in)[None, :] < length[:, None]
    ids = [[field.index[f] for f in block] for page in pages for block in page]
    flat, owner = np.array([i for block in ids for i in block]), np.repeat(np.arange(len(ids)), [len(b) for b in ids])
    params = [field.state, field.move, field.start]
    seen = [np.full(p.shape, 1e-6) for p in params]
    for _ in range(steps):
        scores, _ = field.scores(pages)
        ahead = np.zeros((n, steps_in, 2))
        ahead[:, 0] = scores[:, 0] + field.start
        for t in range(1, steps_in):
            ahead[:, t] = _log_add(ahead[:, t - 1, :, None] + field.move[None], 1) + scores[:, t]
        after = np.zeros((n, steps_in, 2))
        for t in range(steps_in - 2, -1, -1):
            step = _log_add(field.move[None] + (scores[:, t + 1] + after[:, t + 1])[:, None, :], 2)
            after[:, t] = np.where((t + 1 < length)[:, None], step, 0)
        total = _log_add(ahead[np.arange(n), length - 1], 1)
        single = np.exp(ahead + after - total[:, None, None])
        difference = -single
        np.put_along_axis(difference, gold[:, :, None], np.take_along_axis(difference, gold[:, :, None], 2) + 1, 2)
        state = np.zeros_like(field.state)
        np.add.at(state, flat, difference[row, column][owner])
        move = np.zeros((2, 2))
        for t in range(1, steps_in):
            both = inside[:, t]
            pair = np.exp(ahead[both, t - 1, :, None] + field.move[None] + (scores[both, t] + after[both, t])[:, None, :] - total[both, None, None])
            move -= pair.sum(0)
            np.add.at(move, (gold[both, t - 1], gold[both, t]), 1)
        for p, s, g in zip(params, seen, (state, move, difference[:, 0].sum(0))):
            g = g - decay * n * p
            s += g * g
            p += rate * g / np.sqrt(s)
    return field


def labels_from_text(blocks: list[tuple[str, frozenset[str], int]], text: str) -> list[int]:
    """Which blocks make up a labelled page's main text: those found in it one after the other."""
    at, out = 0, []
    for block, _, _ in blocks:
        found = text.startswith(block, at)
        out.append(int(found))
        if found:
            at += len(block) + 1
    return out


def generated_pages(n: int = GENERATED, seed: int = 5) -> list[tuple[str, str]]:
    """(html, main text) of made-up pages in common layouts: the labelled pages used where none are given."""
    rng = random.Random(seed)
    syllables = "ba de ki lo mu na pe ri so tu va we xo yi za ch el in or st".split()

    def words(low: int, high: int, mark: str = "") -> str:
        found = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(found).capitalize() + mark

    def sentences(low: int, high: int) -> str:
        """Prose; now and then shouted, as a run of cells, or with marks after its words, as poor pages have it."""
        style = rng.random()
        if style > 0.85:
            found = words(3, 40).split()
            if style > 0.95:
                return " | ".join(found)
            return " ".join(w + rng.choice(["###", "***", "$$$", "%%%"]) for w in found) if style > 0.9 else " ".join(w.upper() + "!!" for w in found)
        return " ".join(words(3, 14, rng.choice("....!?")) for _ in range(rng.randint(low, high)))

    def links(count: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(count))

    def boxed(names: str, inner: str) -> str:
        return f'<{(tag := rng.choice(["div", "section", "aside"]))} {rng.choice(["class", "id"])}="{rng.choice(names.split())}">{inner}</{tag}>'

    def other(kind: str) -> str:
        prose = f"<p>{sentences(1, 3)}</p>" if rng.random() < 0.6 else sentences(1, 2)
        return {
            "nav": lambda: rng.choice([f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f"<ul>{links(rng.randint(3, 8))}</ul>", f"<table><tr>{links(4).replace('li>', 'td>')}</tr></table>"]),
            "menu": lambda: rng.choice([boxed("menu navbar breadcrumb topbar", f"<ul>{links(rng.randint(2, 6))}</ul>"), f"<div>{' | '.join(f'<a href=/{k}>{words(1, 2)}</a>' for k in range(rng.randint(2, 6)))}</div>"]),
            "header": lambda: f"<header><div>{words(1, 4)}</div><p>{words(3, 8)}</p></header>",
            "footer": lambda: rng.choice([f"<footer>&copy; {words(1, 3)} &middot; {sentences(1, 2)}</footer>", f"<footer><p>{sentences(1, 2)}</p><ul>{links(3)}</ul></footer>", f"<{(tag := rng.choice(['div', 'p', 'td']))}>Copyright {rng.randint(1996, 2030)} {words(1, 4, '.')} {words(1, 5, '.')}</{tag}>", f"<div><a href=/a>{words(1, 2)}</a> &copy; {words(1, 4)}</div>"]),
            "side": lambda: rng.choice([f"<aside><h3>{words(1, 3)}</h3>{prose}<ul>{links(4)}</ul></aside>", boxed("sidebar widget related popular", f"<h4>{words(1, 3)}</h4>{prose}")]),
            "ad": lambda: boxed("ad ads advert sponsored promo", prose),
            "note": lambda: boxed("cookie-notice consent notice alert gdpr", prose + f"<button>{words(1, 2)}</button>"),
            "form": lambda: f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><p>{words(2, 9)}</p><button>{words(1, 2)}</button></form>',
            "talk": lambda: boxed("comments comment-list discussion", f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{sentences(1, 4)}</p></div>' for _ in range(rng.randint(1, 4)))),
        }[kind]()

    def theme(names: str) -> str:
        """A class as themes have them: what an element is, with words on what stands beside it, or none of that."""
        beside = rng.choice(["", "", "with-sidebar", "has-sidebar", "no-sidebar", "right-sidebar", "sidebar-left", "clearfix", "col-md-8", "header-fixed"])
        return " ".join(x for x in rng.sample([rng.choice(names.split()), beside], 2) if x)

    pages = []
    for k in range(n):
        title, main, inner = words(2, 12), [], ""
        heading, lines, bare = rng.random(), rng.random(), rng.random() < 0.1  # bare: nothing but main text
        short = bare and rng.random() < 0.6
        heading = 1 if short and rng.random() < 0.7 else heading
        if heading < 0.7:
            level = 1 if heading < 0.5 else rng.choice([2, 3])
            inner = f"<h{level}>{title}</h{level}>"
            main.append(title)
        if not short and rng.random() < 0.4:
            lead = sentences(1, 2) if rng.random() < 0.5 else title
            inner += rng.choice([f"<p><b>{lead}<br>", f"<p>{lead}</p>", f"<p><em>{lead}</em></p>"])
            main.append(lead)
        for _ in range(rng.randint(1, 2 if short else 14)):
            kind, body = rng.random(), sentences(1, 8) if rng.random() < 0.85 else words(1, 3, ".")
            if kind < 0.1:
                head = words(1, 6)
                inner += f"<h2>{head}</h2>"
                main.append(head)
            if short and rng.random() < 0.5:
                inner += body
                main.append(body)
                break
            if lines < 0.15:
                inner += body + rng.choice(["<br>", "<br/>\n", "<br><br>"])
                main.append(body)
            elif kind < 0.9:
                inner += rng.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}\n", f"<div>{body}</div>"] if lines < 0.3 else [f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}\n"])
                main.append(body)
            elif kind < 0.95:
                inner += f"<blockquote>{body}</blockquote>"
                main.append(body)
            else:
                items = [words(2, 9) for _ in range(3)]
                inner += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
                main += items
            if not bare and rng.random() < 0.05:
                inner += other(rng.choice(["ad", "note", "side"]))
        shell, plain = rng.random(), f'class="{words(1, 2).lower()}"'
        if shell < 0.36:
            inner = f"<article>{inner}</article>"
        elif shell < 0.44:
            inner = f"<main>{inner}</main>"
        elif shell < 0.62:
            name = theme("content post entry-content story article-body main-content site-main post-body page-content")
            inner = f'<div {rng.choice(["class", "id"])}="{name}">{inner}</div>'
        elif shell < 0.72:
            inner = f"<div>{inner}</div>"
        elif shell < 0.8:
            inner = f"<div {plain}><section>{inner}</section></div>"
        elif shell < 0.9:
            cells = inner.replace("<p>", "<td>").replace("</p>", "</td>") if rng.random() < 0.3 else f"<td>{inner}</td>"
            inner = f"<table {plain}><tr>{cells}</tr></table>"
        if rng.random() < 0.15:
            inner = f'<div class="{theme("site wrap container page layout")}">{inner}</div>'
        head = f"<head><title>{title}</title><style>p{{}}</style><script>var x='</p>';</script></head>"
        if bare:
            pages.append((rng.choice([f"<html>{head}<body>{inner}</body></html>", inner]), html.unescape(" ".join(main))))
            continue
        before = [other(x) for x in rng.sample(["nav", "menu", "header", "note", "ad", "form"], rng.randint(1, 4))]
        behind = [other(x) for x in rng.sample(["side", "ad", "talk", "form", "note"], rng.randint(0, 4))] + [other("footer")] * (rng.random() < 0.9)
        page = "".join(before) + inner + "".join(behind)
        around = rng.random()
        if around < 0.15:
            page = f'<div {rng.choice(["class", "id"])}="{theme("site page wrap wrapper container layout")}">{page}</div>'
        elif around < 0.2:  # an outer wrapper whose name is that of a part of it
            page = f'<div class="{rng.choice(["site-header-fixed site", "layout header footer", "page sidebar", "banner-page"])}">{page}</div>'
        body = f' class="{theme("home single post page")}"' if rng.random() < 0.3 else ""
        pages.append((f"<!DOCTYPE html><html>{head}<body{body}>{page}</body></html>", html.unescape(" ".join(main))))
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field of the generated pages; it hangs on nothing else, so a process fits it once."""
    return trained(generated_pages())


def trained(pages: list[tuple[str, str]] | None = None) -> Field:
    """A field fitted on labelled pages, at most MAX_LABELLED of them."""
    if pages is None:
        return default_field()
    examples = []
    for page, text in pages[:MAX_LABELLED]:
        blocks = blocks_of(page or "")
        examples.append((features_of(blocks), labels_from_text(blocks, text or "")))
    return fit(examples, steps=max(80, min(300, 56_000 // max(1, len(examples)))))  # few pages need more steps, and take less time for each


def extract(pages: DataFrame, labelled: DataFrame | None = None, html_column: str = "html") -> DataFrame:
    """pages with text and n_chars. labelled: (html, text), of which a bounded number of rows is read."""
    known = None
    if labelled is not None:
        rows = labelled.select("html", "text").orderBy(F.xxhash64("html"), "html", "text").limit(MAX_LABELLED).collect()
        known = [(r.html, r.text) for r in rows]
    shared = pages.sparkSession.sparkContext.broadcast(trained(known))
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = pages.select(*[F.col(f"`{c}`") for c in keep]).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    at = len(keep) if html_column not in keep else keep.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts: list[str] = []
            raw = batch.column(at)
            for low, high in byte_slices(raw, 1 << 20):
                found = [blocks_of(p or "") for p in raw.slice(low, high - low).to_pylist()]
                labels = field.viterbi([features_of(b) for b in found])
                texts += [" ".join(b[0] for b, y in zip(blocks, own) if y) for blocks, own in zip(found, labels)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
