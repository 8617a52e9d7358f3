"""Main-text extraction by a recurrent block labeller.

A page is read as its sequence of leaf blocks: runs of text between block-level
tags, each with the path of open tags (and their class and id words).  A block
becomes a vector: the mean of learned rows for the hashed parts of its tag path,
the mean of learned rows for its hashed words, and a few measures (length, share
of linked text, place in the page).  A bidirectional LSTM in numpy reads the
whole sequence, so that every block is labelled in the light of all the others;
blocks labelled as main text are joined.

There are no labelled pages, so the network learns from two bounded sources:
``SAMPLE`` pages of the table, with labels from their structural tags, and
``MADE`` generated pages of many layouts (menus, headers, sidebars, notices,
adverts, forms, comments, with and without telling class names), filled with the
sampled pages' own words.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import text

SAMPLE, LONGEST, MADE, EPOCHS, RATE, HIDDEN = 300, 200_000, 900, 5, 0.01, 16
#: Pages are labelled together up to so many characters of html.
TOGETHER = 4 << 20
PATH_ROWS, WORD_ROWS, PATH_SIZE, WORD_SIZE, MEASURES = 2048, 1024, 16, 4, 6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
_ENDED = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes if it is the innermost block.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    """An open tag. What its path says is summed up from the parent's, so a deep page costs no more than a flat one of its length."""

    __slots__ = ("inline", "last", "links", "mask", "run", "tag", "told")

    def __init__(self, tag: str, parts: tuple[str, ...], above: "Node | None", at: int):
        self.tag, self.inline = tag, tag in _INLINE
        self.mask, self.told, self.last = (above.mask, above.told, above.last) if above else (0, frozenset(), ())
        for p in parts:
            self.mask |= 1 << _slot(p)  # slots of all parts in the path
        self.last = (*self.last, *parts)[-2:]  # the innermost parts
        if not _TELLING.isdisjoint(parts):
            self.told |= _TELLING.intersection(parts)  # those that lessons are taken from
        self.run = above.run if above and above.inline and self.inline else at  # where the run of inline tags begins
        self.links = 3 if tag == "a" else max(0, above.links - 1) if above else 0  # within a link, up to two tags below it


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag; comments and declarations have no name. Each character is read a few times at most."""
    at, last, quotes = 0, page.rfind(">"), True
    while 0 <= (start := page.find("<", at)):
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            close = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(close, start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        if page[start + 1 : start + 2] in ("!", "?") and start < last:
            at = page.find(">", start) + 1
            yield start, at, "", False, ""
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            at = start + 1
            continue
        if start > last:  # cut off within a tag
            yield start, len(page), "", False, ""
            return
        end, j = -1, name.end()
        while quotes and (m := _STOP.search(page, j)):
            if m[0] == ">":
                end = m.start()
                break
            k = page.find(m[0], m.end())
            j = k + 1 if k >= 0 else m.end()
        if end < 0:  # all that would close it is within quotes: from here on they mean nothing
            quotes, end = False, page.find(">", name.end())
        at = end + 1
        yield start, at, name[0].lower(), closing, page[name.end() : end]


def blocks(page: str) -> list[tuple[Node | None, str, int]]:
    """(innermost open tag, text, characters within links) of each leaf block with text."""
    out: list[tuple[Node | None, str, int]] = []
    stack: list[Node] = []
    spots: dict[str, list[int]] = {}  # where in the stack each tag is open
    held: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal linked
        if held:
            t = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if t:
                out.append((stack[-1] if stack else None, t, linked))
            held.clear()
        linked = 0

    def take(s: str) -> None:
        nonlocal linked
        if s:
            held.append(s)
            if stack and stack[-1].links:
                linked += len(s)

    def pop(to: int) -> None:
        while len(stack) > to:
            spots[stack.pop().tag].pop()

    for start, end, tag, closing, attributes in _tags(page):
        if start < at:
            continue  # within a script or the like
        take(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _RAW and not closing:
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else len(page)
            if tag not in _INLINE:
                close()
            continue
        inline = tag in _INLINE
        if tag == "br":
            held.append(" ")
        if not inline:
            close()
        if closing:
            if spots.get(tag) and (not inline or stack[-1].inline and spots[tag][-1] >= stack[-1].run):
                pop(spots[tag][-1])
            continue
        if not inline:
            while stack and (stack[-1].inline or stack[-1].tag in _ENDED or stack[-1].tag in _CLOSES.get(tag, ())):
                pop(len(stack) - 1)
        if tag in _VOID or attributes.endswith("/"):
            continue
        words = [w for a in _ATTRIBUTE.finditer(attributes) for w in _PARTS.findall((a[2] or a[3] or a[4] or "").lower())] if attributes else []
        spots.setdefault(tag, []).append(len(stack))
        stack.append(Node(tag, (tag, *[f".{w}" for w in dict.fromkeys(words)]), stack[-1] if stack else None, len(stack)))
    take(page[at:])
    close()
    return out


# ---- features --------------------------------------------------------------


def features(pages: list[list[tuple[Node | None, str, int]]]) -> dict[str, np.ndarray]:
    """Paths (as numbers of distinct ones, whose hashed parts are ragged), hashed words (ragged) and measures of all blocks of some pages."""
    flat = [b for p in pages for b in p]
    size = np.array([len(p) for p in pages], np.int64)
    numbers: dict[tuple, int] = {}
    path = np.array([numbers.setdefault((n.mask, n.last) if n else (0, ()), len(numbers)) for n, _, _ in flat], np.int64)
    # Parts anywhere in the path, and the innermost ones once more.
    masks = np.frombuffer(b"".join(mask.to_bytes(PATH_ROWS // 8, "little") for mask, _ in numbers), np.uint8).reshape(-1, PATH_ROWS // 8)
    inner = [[_slot("^" + p) for p in last] or [0] for _, last in numbers]
    n_inner = np.array([len(p) for p in inner], np.int64)
    texts = [t for _, t, _ in flat]
    c = next(text.chunks(pa.array(texts, pa.string()), 1 << 62), None)
    w = text.words(c, text.ALNUM, text.LOWER) if c else text.Words(*(np.zeros(0, np.int64),) * 2, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    words = w.counts()
    chars = np.array([len(t) for t in texts], float)
    links = np.array([x for _, _, x in flat], float)
    place = text.ragged(np.zeros(len(size), np.int64), size) / np.maximum(1, np.repeat(size, size))
    ends = np.array([t[-1] in ".!?…。" for t in texts], float)
    measures = np.stack([np.log1p(words) / 5, np.minimum(1, links / np.maximum(chars, 1)), place, ends, words < 5, words > 25], 1) if flat else np.zeros((0, MEASURES))
    return {"size": size, "path": path, "masks": masks, "inner": np.array([x for p in inner for x in p], np.int64), "n_inner": n_inner, "words": (w.hashes % np.uint64(WORD_ROWS)).astype(np.int64), "n_words": words, "measures": measures}


@functools.lru_cache(1 << 16)
def _slot(part: str) -> int:
    h = 1469598103934665603
    for b in part.encode():
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return (h ^ h >> 29) % PATH_ROWS


def _means(table: np.ndarray, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
    total, some, first = np.zeros((len(n), table.shape[1])), np.flatnonzero(n), np.cumsum(n) - n
    lo = 0
    while lo < len(some):  # some entries at a time, so that memory is bounded
        hi = max(lo + 1, int(np.searchsorted(first[some], first[some[lo]] + (1 << 18))))
        begin, end = first[some[lo]], first[some[hi - 1]] + n[some[hi - 1]]
        total[some[lo:hi]] = np.add.reduceat(table[slots[begin:end]], first[some[lo:hi]] - begin, axis=0)
        lo = hi
    return total / np.maximum(n, 1)[:, None]


def _bits(masks: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The parts of some paths at a time, as ones and zeros."""
    for lo in range(0, len(masks), 4096):
        part = slice(lo, lo + 4096)
        yield part, np.unpackbits(masks[part], axis=1, bitorder="little").astype(float)


def _path_means(table: np.ndarray, f: dict[str, np.ndarray]) -> np.ndarray:
    """Mean of the rows of each path's parts, the innermost ones once more."""
    out = _means(table, f["inner"], f["n_inner"]) * f["n_inner"][:, None]
    for part, bits in _bits(f["masks"]):
        out[part] = (out[part] + bits @ table) / (f["n_inner"][part] + bits.sum(1))[:, None]
    return out


class Labeller:
    """Embeddings, a bidirectional LSTM and a logistic output."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = PATH_SIZE + WORD_SIZE + MEASURES, HIDDEN
        self.p = {"path": r.normal(0, 0.3, (PATH_ROWS, PATH_SIZE)), "word": r.normal(0, 0.05, (WORD_ROWS, WORD_SIZE)), "out": r.normal(0, 0.2, 2 * h + d), "out_b": np.zeros(1)}
        for way in ("f", "b"):
            self.p["w" + way] = r.normal(0, 1 / np.sqrt(d + h), (d + h, 4 * h))
            self.p["c" + way] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])

    def _inputs(self, f: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([_path_means(self.p["path"], f)[f["path"]], _means(self.p["word"], f["words"], f["n_words"]), f["measures"]], 1)

    def _run(self, x: np.ndarray, w: np.ndarray, c: np.ndarray, live: np.ndarray, at: np.ndarray, keep: bool):
        """Hidden states by time, over rows that are longest first."""
        h = HIDDEN
        out, kept = np.zeros((len(x), h)), []
        z = x @ w[: x.shape[1]] + c
        hid = cell = np.zeros((live[0] if len(live) else 0, h))
        for t, n in enumerate(live):
            g = z[at[t] : at[t] + n] + hid[:n] @ w[x.shape[1] :]
            gate = 1 / (1 + np.exp(-g[:, : 3 * h]))
            new = np.tanh(g[:, 3 * h :])
            before = cell[:n]
            cell = gate[:, h : 2 * h] * before + gate[:, :h] * new
            soft = np.tanh(cell)
            if keep:
                kept.append((hid[:n], before, gate, new, soft))
            hid = gate[:, 2 * h :] * soft
            out[at[t] : at[t] + n] = hid
        return out, kept

    def _back(self, d_out: np.ndarray, x: np.ndarray, w: np.ndarray, live: np.ndarray, at: np.ndarray, kept):
        h, dim = HIDDEN, x.shape[1]
        dw, dz = np.zeros_like(w), np.zeros((len(x), 4 * h))
        dh = dc = np.zeros((0, h))
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            hid, before, gate, new, soft = kept[t]
            a, b = d_out[at[t] : at[t] + n].copy(), np.zeros((n, h))
            a[: len(dh)] += dh
            b[: len(dc)] += dc
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            b += a * o * (1 - soft * soft)
            g = np.concatenate([b * new * i * (1 - i), b * before * f * (1 - f), a * soft * o * (1 - o), b * i * (1 - new * new)], 1)
            dz[at[t] : at[t] + n] = g
            dw[dim:] += hid.T @ g
            dh, dc = g @ w[dim:].T, b * f
        dw[:dim] = x.T @ dz
        return dw, dz.sum(0), dz @ w[:dim].T

    def forward(self, f: dict[str, np.ndarray], keep: bool = False):
        size = f["size"]
        rows = np.argsort(-size, kind="stable")
        rows = rows[size[rows] > 0]
        first = np.cumsum(size) - size
        s = size[rows]
        live = np.searchsorted(-s, -np.arange(1, (s[0] if len(s) else 0) + 1), "right")
        at = np.cumsum(live) - live
        time, who = text.ragged(np.zeros(len(s), np.int64), s), np.repeat(np.arange(len(s)), s)
        spot = at[time] + who if len(s) else time
        order_f, order_b = np.empty(len(spot), np.int64), np.empty(len(spot), np.int64)
        order_f[spot] = first[rows][who] + time
        order_b[spot] = first[rows][who] + s[who] - 1 - time
        x = self._inputs(f)
        hf, kf = self._run(x[order_f], self.p["wf"], self.p["cf"], live, at, keep)
        hb, kb = self._run(x[order_b], self.p["wb"], self.p["cb"], live, at, keep)
        both = np.zeros((len(x), 2 * HIDDEN))
        both[order_f, :HIDDEN] = hf
        both[order_b, HIDDEN:] = hb
        z = np.concatenate([both, x], 1) @ self.p["out"] + self.p["out_b"]
        return 1 / (1 + np.exp(-z)), (x, both, order_f, order_b, kf, kb, live, at)

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        prob, (x, both, of, ob, kf, kb, live, at) = self.forward(f, keep=True)
        d = (prob - y) / max(1, len(y))
        g = {"out": np.concatenate([both, x], 1).T @ d, "out_b": np.array([d.sum()])}
        dall = d[:, None] * self.p["out"][None]
        dx = dall[:, 2 * HIDDEN :].copy()
        for way, order, kept, part in (("f", of, kf, dall[:, :HIDDEN]), ("b", ob, kb, dall[:, HIDDEN : 2 * HIDDEN])):
            g["w" + way], g["c" + way], back = self._back(part[order], x[order], self.p["w" + way], live, at, kept)
            dx[order] += back
        per_path = np.zeros((len(f["masks"]), PATH_SIZE))
        np.add.at(per_path, f["path"], dx[:, :PATH_SIZE])
        g["path"] = np.zeros_like(self.p["path"])
        for part, bits in _bits(f["masks"]):
            per_path[part] /= (f["n_inner"][part] + bits.sum(1))[:, None]
            g["path"] += bits.T @ per_path[part]
        np.add.at(g["path"], f["inner"], np.repeat(per_path, f["n_inner"], axis=0))
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], f["words"], np.repeat(dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / np.maximum(f["n_words"], 1)[:, None], f["n_words"], axis=0))
        return g

    def train(self, pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, seed: int = 12) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for lo in range(0, len(order), 32):
                got = [pages[i] for i in order[lo : lo + 32]]
                y = np.array([x for _, labels in got for x in labels], float)
                if not len(y):
                    continue
                step += 1
                for k, g in self.gradient(features([b for b, _ in got]), y).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)


# ---- what it learns from ---------------------------------------------------

_OUTSIDE = frozenset({"nav", "footer", "aside", "form", "head", "title", "menu", "button", "select", "dialog", "fieldset", "option"})
_WORDS = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "links", "pagination", "pager", "tabs", "toc"],
    "header": ["header", "masthead", "banner", "top", "logo", "branding", "site"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon", "imprint"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "promo", "rail", "more"],
    "notice": ["notice", "cookie", "consent", "cookies", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "overlay", "privacy"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promotion", "banner", "adbox"],
    "form": ["form", "search", "login", "signup", "contact", "poll"],
    "comments": ["comments", "comment", "replies", "reply", "discussion", "respond", "disqus", "thread"],
    "share": ["share", "social", "sharing", "meta", "tags", "byline"],
    "main": ["article", "content", "main", "post", "entry", "story", "body", "text", "page", "wrapper", "container"],
}


#: Class words that say that a block is set apart.
_APART = frozenset(f".{w}" for k in _WORDS if k not in ("main", "header", "share") for w in _WORDS[k] if w not in ("top", "more", "bottom", "links", "form"))
_TELLING = frozenset({"article", "main", "header"}) | _OUTSIDE | _APART


def structural(got: list) -> list[int]:
    """Labels of a page's blocks from its tags: within article or main, and in nothing that is set apart."""
    told = [n.told if n else frozenset() for n, _, _ in got]
    rooted = any(not t.isdisjoint(("article", "main")) for t in told)
    apart = _OUTSIDE | _APART
    return [int((not rooted or not t.isdisjoint(("article", "main"))) and t.isdisjoint(apart) and not ("header" in t and "article" not in t)) for t in told]


def made_page(r: np.random.Generator, pool: list[str]) -> tuple[str, list[tuple[str, int]]]:
    """A page of a random layout, and its blocks' texts with labels."""
    told: list[tuple[str, int]] = []

    def say(lo: int, hi: int, stop: str = "") -> str:
        i = int(r.integers(0, max(1, len(pool) - hi - 1)))
        return " ".join(pool[i : i + int(r.integers(lo, hi + 1))]) + stop

    def tell(t: str, label: int) -> str:
        told.append((t, label))
        return t

    def named(kind: str, tag: str) -> str:
        words = _WORDS[kind]
        if r.random() < 0.15:
            return f"<{tag}>"
        w = words[int(r.integers(len(words)))]
        w += ["", "-" + _WORDS["main"][int(r.integers(10))], "_box", "1"][int(r.integers(4))]
        return f'<{tag} {"class" if r.random() < 0.7 else "id"}="{w}">'

    def items(n: int) -> str:
        bare = r.random() < 0.3
        rows = "".join((lambda t: f"<a href='/x'>{t}</a>" if bare else f"<li><a href='/x'>{t}</a></li>")(say(1, 3)) + ("" if not bare else "\n") for _ in range(n))
        plain = re.findall(r"<a href='/x'>(.*?)</a>", rows)
        if bare:
            tell(" ".join(plain), 0)
            return f"<div>{rows}</div>"
        for t in plain:
            tell(t, 0)
        return f"<ul>{rows}</ul>"

    def box(kind: str) -> str:
        if kind == "menu":
            tag = ["nav", "div", "ul"][int(r.integers(3))]
            return named(kind, tag) + items(int(r.integers(2, 9))) + f"</{tag}>"
        if kind == "header":
            tag = ["header", "div"][int(r.integers(2))]
            return named(kind, tag) + f"<{'h1' if r.random() < 0.3 else 'div'}>" + tell(say(1, 4), 0) + "</div>" + (box("menu") if r.random() < 0.5 else "") + f"</{tag}>"
        if kind == "footer":
            tag = ["footer", "div"][int(r.integers(2))]
            return named(kind, tag) + f"<p>{tell('© ' + say(2, 14), 0)}</p>" + (items(3) if r.random() < 0.4 else "") + f"</{tag}>"
        if kind == "side":
            tag = ["aside", "div", "section"][int(r.integers(3))]
            head = f"<h3>{tell(say(1, 4), 0)}</h3>"
            return named(kind, tag) + head + (items(4) if r.random() < 0.6 else f"<p>{tell(say(5, 30, '.'), 0)}</p>") + f"</{tag}>"
        if kind in ("notice", "ad"):
            return named(kind, "div") + (f"<p>{tell(say(3, 30, '.'), 0)}</p>" if r.random() < 0.5 else tell(say(3, 30, "."), 0)) + (f"<button>{tell(say(1, 2), 0)}</button>" if kind == "notice" and r.random() < 0.5 else "") + "</div>"
        if kind == "form":
            return named(kind, "form") + f"<p>{tell(say(1, 8), 0)}</p><input name='q'><button>{tell(say(1, 2), 0)}</button></form>"
        if kind == "share":
            return named(kind, "div") + items(int(r.integers(2, 5))) + "</div>"
        tag = ["section", "div", "ol"][int(r.integers(3))]
        rows = "".join(f'<{"li" if tag == "ol" else "div"} class="{_WORDS["comments"][int(r.integers(2))]}"><b>' + tell_pair(say(1, 2), say(4, 40, ".")) + "</div>" for _ in range(int(r.integers(1, 5))))
        head = f"<h3>{tell_first(say(1, 3))}</h3>"
        return f'<{tag} {"class" if r.random() < 0.5 else "id"}="{_WORDS["comments"][int(r.integers(8))]}">' + head + rows + f"</{tag}>"

    def tell_pair(who: str, what: str) -> str:
        tell(who, 0)
        tell(what, 0)
        return f"{who}</b><p>{what}</p>"

    def tell_first(t: str) -> str:
        tell(t, 0)
        return t

    def body() -> str:
        tag = ["article", "article", "main", "div", "section"][int(r.integers(5))]
        name = named("main", tag) if r.random() < 0.6 or tag == "div" else f"<{tag}>"
        title = tell(say(2, 10), 1)
        out = name + (f"<header><h1>{title}</h1></header>" if r.random() < 0.2 else f"<h1>{title}</h1>")
        for i in range(int(r.integers(1, 9))):
            x = r.random()
            if x < 0.08 and i:
                out += f"<h2>{tell(say(1, 6), 1)}</h2>"
            elif x < 0.14:
                out += "<ul>" + "".join(f"<li>{tell(say(2, 12), 1)}</li>" for _ in range(3)) + "</ul>"
            elif x < 0.19:
                out += f"<blockquote>{tell(say(5, 40, '.'), 1)}</blockquote>"
            elif x < 0.24:
                out += f"<table><tr><td>{tell(say(1, 4), 1)}</td><td>{tell(say(1, 4), 1)}</td></tr></table>"
            elif x < 0.34:
                out += box(["ad", "share", "form", "side"][int(r.integers(4))])
            out += "<p>" + ("<b>" if r.random() < 0.15 else "") + tell(say(3, 70, "."), 1) + ("" if r.random() < 0.15 else "</p>")
        return out + (box("comments") if r.random() < 0.25 else "") + (f"</{tag}>" if r.random() < 0.95 else "")

    page = "<html><head><title>" + tell(say(2, 10), 0) + "</title></head><body>"
    for kind, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("ad", 0.5), ("form", 0.15)):
        page += box(kind) if r.random() < p else ""
    left = r.random() < 0.2
    page += box("side") if left else ""
    page += body()
    for kind, p in (("share", 0.2), ("comments", 0.3), ("side", 0.4), ("ad", 0.2), ("form", 0.15), ("menu", 0.15), ("notice", 0.15), ("footer", 0.85)):
        page += box(kind) if r.random() < p else ""
    return page + "</body></html>", told


def lessons(pages: list[str], made: int = MADE, seed: int = 13) -> list[tuple[list, list[int]]]:
    r = np.random.default_rng(seed)
    out = []
    pool: list[str] = []
    for p in pages:
        got = blocks(p)
        if got:
            out.append((got, structural(got)))
            pool += [w for _, t, _ in got for w in t.split(" ")]
    pool = pool or [f"w{i}" for i in range(5000)]
    for _ in range(made):
        page, told = made_page(r, pool)
        # Told texts and blocks in step: a block that isn't as told was cut otherwise and is left out with its page.
        got = blocks(page)
        want: dict[str, list[int]] = {}
        for t, label in told:
            want.setdefault(_SPACE.sub(" ", entities.unescape(t)).strip(), []).append(label)
        labels = [want[t][0] if t in want and len(set(want[t])) == 1 else -1 for _, t, _ in got]
        if got and -1 not in labels:
            out.append((got, labels))
    return out


def train(df: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE, longest: int = LONGEST) -> Labeller:
    """A labeller from at most ``sample`` pages of fewer than ``longest`` bytes (by the hash of their id) and generated ones.

    The two bounds hold for what is learnt from alone; every page is read whole.
    """
    rows = df.select(F.xxhash64(df[id_col], F.lit(5)).alias("h"), df[id_col].alias("id"), df[html_col].cast("string").alias("html")).where(f"html is not null and octet_length(html) < {longest}")
    ids = rows.select("h", "id").orderBy("h", "id").limit(sample)
    got = rows.join(F.broadcast(ids.select("h").distinct()), "h", "left_semi").orderBy("h", "html").limit(sample).collect()
    out = Labeller()
    out.train(lessons([r["html"] for r in got]))
    return out


def extract(df: DataFrame, labeller: Labeller, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of carry, text and n_chars, for every row, from its whole html.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space in page order.  Null and empty html, and
    html without text, give an empty text.  Rows that repeat give the same.  A page of
    any length and depth is read whole, in time proportional to its length.  Columns
    not named in ``carry`` don't pass through; those named may not be text or n_chars.
    """
    if clash := set(carry) & {"text", "n_chars"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    docs = df.select(df[html_col].cast("string").alias("__html"), *[df[c] for c in carry])
    schema = T.StructType([*docs.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return docs.mapInArrow(_extract(df.sparkSession.sparkContext.broadcast(labeller), to_arrow_schema(schema)), schema)


def main_text(labeller: Labeller, pages: list[str]) -> list[str]:
    got = [blocks(p) for p in pages]
    prob, _ = labeller.forward(features(got))
    out, at = [], 0
    for p in got:
        out.append(" ".join(t for (_, t, _), x in zip(p, prob[at : at + len(p)], strict=True) if x >= 0.5))
        at += len(p)
    return out


def _extract(shared, schema: pa.Schema):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(0)), 0))
            lo = 0
            while lo < batch.num_rows:
                rows = max(1, min(256, int(np.searchsorted(np.cumsum(sizes[lo:]), TOGETHER, "right"))))
                part = batch.slice(lo, rows)
                lo += rows
                texts = main_text(shared.value, [x or "" for x in part.column(0).to_pylist()])
                out = [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts])]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema, strict=True)], schema=schema)

    return go
