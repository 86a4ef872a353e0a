"""Main text of web pages: a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks: text between block-level tags, with
the path of open elements. Each block's vector has the sum of the path's hashed names,
the mean of its words' vectors (hashed to buckets, learnt with the rest) and a few
shares. A bidirectional LSTM in numpy reads the whole sequence, and a
logistic layer labels every block as main text or not.

The network is trained here, on pages from a seeded generator whose blocks are
labelled as they are written; their number is a parameter. No page of the input is
used. Training takes some seconds on the driver, once a process; the weights, some
1 MB, are broadcast.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by what they do to a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button title".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]{2,}")

PATH_SIZE, WORD_SIZE, SHARES, HIDDEN = 96, 24, 4, 32
WORD_BUCKETS = 8192
TRAINING_PAGES, BATCH_PAGES, RATE = 6000, 32, 0.01
MARK = "\ue000"


@lru_cache(maxsize=20_000)
def _direction(name: str) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(name.encode())).standard_normal(PATH_SIZE).astype(np.float32) / 4


class Path:
    """An open block element below others; it holds the sum of all their names' directions, so no path is walked."""

    __slots__ = ("name", "words", "above", "total", "count")

    def __init__(self, name: str, words: tuple[str, ...] = (), above: Path | None = None):
        self.name, self.words, self.above = name, words, above
        self.total, self.count = (above.total, above.count) if above else (np.zeros(PATH_SIZE, np.float32), 0)
        if name:
            self.total = self.total + _direction(name)
            for w in words:
                self.total += _direction(f".{w}")
            self.count += 1 + len(words)

    def vector(self) -> np.ndarray:
        """The innermost element counts twice."""
        total = self.total + _direction(f">{self.name}") if self.name else self.total
        return total / np.sqrt(self.count + 1, dtype=np.float32)

    def names(self) -> list[str]:
        """Outermost first."""
        at, out = self, []
        while at and at.name:
            out += [*(f".{w}" for w in reversed(at.words)), at.name]
            at = at.above
        return out[::-1]


OUTSIDE = Path("")


def blocks(page: str | None) -> list[tuple[Path, str, float]]:
    """(path, text, share of text in links) of the leaf blocks that have text, in order.

    References are decoded and white space is one space. A path holds the names of open
    block elements and the words of their classes and ids. A head ends at its end
    tag, or at the first element or text that can't be in one. Time and memory are in
    proportion to the page, however deep its elements lie.
    """
    if not page:
        return []
    out, stack, opened, at, text, links, linked, hidden = [], [OUTSIDE], {}, 0, [], 0, 0, 0

    def cut(k: int) -> int:
        """Closes the elements from place k on; how many of them hid their text."""
        unseen = 0
        for x in stack[k:]:
            opened[x.name] -= 1
            unseen += x.name in UNSEEN
        del stack[k:]
        return unseen

    def close() -> None:
        nonlocal linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                out.append((stack[-1], said, min(1.0, linked / max(1, len(said)))))
            text.clear()
            linked = 0

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if hidden and stack[-1].name == "head" and page[at:end].strip():
            hidden -= cut(len(stack) - 1)
        if end > at and not hidden:
            piece = page[at:end]
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if hidden and stack[-1].name == "head" and not closing and name not in IN_HEAD:
            hidden -= cut(len(stack) - 1)
        if name in RAW and not closing:
            if not hidden and name not in INLINE:
                close()
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in INLINE:
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if closing:
            if opened.get(name):
                if not hidden:
                    close()
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                hidden -= cut(k)
            continue
        if not hidden:
            close()
        links = 0
        if name in CLOSED_BY_SAME and stack[-1].name == name:
            hidden -= cut(len(stack) - 1)
        words = tuple(p for a, b, c in NAMES.findall(attributes) for p in PART.findall((a or b or c).lower())) if attributes and "=" in attributes else ()
        if not attributes.rstrip().endswith("/"):
            stack.append(Path(name, words, stack[-1]))
            opened[name] = opened.get(name, 0) + 1
            hidden += name in UNSEEN
    if not hidden:
        close()
    return out


class Words(dict):
    """Hash buckets of lower-case words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[word] = zlib.crc32(word.lower().strip(".,;:!?()\"'").encode()) % WORD_BUCKETS
        return k


def features(found: list[tuple[Path, str, float]], buckets: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a block, its words' part still zero; the buckets of all words, and each block's number of words."""
    x = np.zeros((len(found), PATH_SIZE + WORD_SIZE + SHARES), np.float32)
    words = [text.split() for _, text, _ in found]
    sizes = np.array([len(w) for w in words], np.int64)
    for k, (path, text, linked) in enumerate(found):
        x[k, :PATH_SIZE] = path.vector()
        x[k, -4:] = np.log1p(sizes[k]) / 4, linked, k / len(found), text[-1] in ".!?:"
    return x, np.array([buckets[w] for ws in words for w in ws], np.int64), sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Lstm:
    """One direction; sequences lie as (time, page, feature)."""

    def __init__(self, size: int, hidden: int, rng: np.random.Generator):
        self.p = {"wx": rng.standard_normal((size, 4 * hidden)) / np.sqrt(size), "wh": rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden), "b": np.zeros(4 * hidden)}
        self.p["b"][hidden:2 * hidden] = 1.0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.hidden = hidden

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        t, n, d = x.shape
        h = self.hidden
        given = (x.reshape(t * n, d) @ self.p["wx"] + self.p["b"]).reshape(t, n, 4 * h)
        state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32), []
        for k in range(t):
            z = given[k] + state @ self.p["wh"]
            gates, new = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before, held = state, cell
            cell = gates[:, h:2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = out[k] = gates[:, 2 * h:] * squashed
            if keep:
                kept.append((before, held, gates, new, squashed))
        return out, kept

    def backward(self, x: np.ndarray, kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        t, n, d = x.shape
        h = self.hidden
        dz = np.empty((t, n, 4 * h), np.float32)
        dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for k in range(t - 1, -1, -1):
            before, held, gates, new, squashed = kept[k]
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            dh = dh + grad[k]
            dc = dc + dh * o * (1 - squashed**2)
            z = dz[k]
            z[:, :h], z[:, h:2 * h], z[:, 2 * h:3 * h], z[:, 3 * h:] = dc * new * i * (1 - i), dc * held * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)
            dh, dc = z @ self.p["wh"].T, dc * f
        flat = dz.reshape(t * n, 4 * h)
        self.down = (flat @ self.p["wx"][PATH_SIZE:PATH_SIZE + WORD_SIZE].T).reshape(t, n, WORD_SIZE)
        return {"wx": x.reshape(t * n, d).T @ flat, "wh": np.concatenate([s[0] for s in kept]).T @ flat, "b": flat.sum(axis=0)}


class Labeller:
    """Two LSTMs, forwards and backwards, and a logistic layer over both."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + SHARES
        self.ahead, self.back = Lstm(size, HIDDEN, rng), Lstm(size, HIDDEN, rng)
        self.words = {"e": (rng.standard_normal((WORD_BUCKETS, WORD_SIZE)) / 50).astype(np.float32)}
        self.top = {"w": (rng.standard_normal(2 * HIDDEN) / 8).astype(np.float32), "b": np.zeros(1, np.float32)}

    def rows(self, made: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Feature rows with the means of their words' vectors."""
        for x, ids, sizes in made:
            if len(ids):
                x[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.add.reduceat(self.words["e"][ids], np.cumsum(sizes) - sizes) / sizes[:, None]
        return [x for x, _, _ in made]

    @staticmethod
    def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences forwards and reversed, zero beyond their ends, and their lengths."""
        lengths = np.array([len(r) for r in rows])
        x = np.zeros((lengths.max(), len(rows), rows[0].shape[1]), np.float32)
        y = np.zeros_like(x)
        for k, r in enumerate(rows):
            x[:len(r), k], y[:len(r), k] = r, r[::-1]
        return x, y, lengths

    @staticmethod
    def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for k, n in enumerate(lengths):
            out[:n, k] = x[:n, k][::-1]
        return out

    def probabilities(self, made: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For each page (features() of a block at least), the chance of each block to be main text."""
        rows = self.rows(made)
        x, y, lengths = self._padded(rows)
        both = np.concatenate([self.ahead.forward(x)[0], self._turned(self.back.forward(y)[0], lengths)], axis=2)
        p = _sigmoid(both @ self.top["w"] + self.top["b"])
        return [p[:n, k] for k, n in enumerate(lengths)]

    def step(self, made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[np.ndarray]) -> tuple[float, list[dict[str, np.ndarray]]]:
        """Mean loss a block, and gradients of both directions, the top and the words' vectors."""
        rows = self.rows(made)
        x, y, lengths = self._padded(rows)
        (a, kept_a), (b, kept_b) = self.ahead.forward(x, True), self.back.forward(y, True)
        both = np.concatenate([a, self._turned(b, lengths)], axis=2)
        p, grad, loss, total = _sigmoid(both @ self.top["w"] + self.top["b"]), np.zeros(x.shape[:2], np.float32), 0.0, lengths.sum()
        for k, (n, want) in enumerate(zip(lengths, labels)):
            grad[:n, k] = (p[:n, k] - want) / total
            loss -= float(np.log(np.where(want > 0, p[:n, k], 1 - p[:n, k]) + 1e-9).sum())
        top = {"w": np.einsum("tn,tnh->h", grad, both), "b": grad.sum(keepdims=True)[0]}
        down = grad[:, :, None] * self.top["w"]
        ahead, back = self.ahead.backward(x, kept_a, down[:, :, :HIDDEN]), self.back.backward(y, kept_b, self._turned(down[:, :, HIDDEN:], lengths))
        into, words = self.ahead.down + self._turned(self.back.down, lengths), np.zeros_like(self.words["e"])
        for k, (_, ids, sizes) in enumerate(made):
            np.add.at(words, ids, np.repeat(into[:lengths[k], k] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        return loss / total, [ahead, back, top, {"e": words}]


class _Pages:
    """Pages with labelled blocks, in many layouts."""

    ROLES = {
        "nav": "nav menu navbar topnav breadcrumb navigation links", "header": "header masthead branding logo topbar hero", "footer": "footer colophon bottom copyright legal",
        "side": "sidebar aside widget rail secondary related", "ad": "ad ads advert sponsored promo banner", "notice": "cookie consent notice alert gdpr popup modal",
        "comments": "comments comment replies discussion respond disqus", "form": "form search newsletter subscribe login signup", "share": "share social tags pager meta byline",
    }
    MAIN = "article main content post entry story body text page"
    SAID = {
        "nav": "home about contact products blog news archive sitemap categories help faq team careers shop cart account", "header": "welcome official website online portal magazine daily journal established homepage",
        "footer": "copyright rights reserved imprint privacy policy terms powered company inc ltd contact us address email sitemap legal",
        "side": "related popular recent posts trending recommended articles also read more tags categories archives links about author", "ad": "sponsored advertisement buy now offer discount sale free shipping deal percent off limited click here shop price order today",
        "notice": "cookies accept consent we use this site browser settings privacy policy agree improve experience decline preferences", "comments": "reply comment comments posted by guest user said ago likes report thanks great leave your",
        "form": "enter your email password name subscribe newsletter sign up log in submit search required field username", "share": "share tweet facebook pin email print follow us by posted tags author minutes read updated",
    }
    STOCK = "home about contact privacy terms login subscribe menu search share cookies accept advertisement reply comments rights reserved follow newsletter previous next tags".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "etaoinshrdlucmfwypvbgkéèüöñçß"
        word = lambda: "".join(self.r.choices(letters, k=self.r.randrange(1, 12)))
        # many more than there are buckets: what no class says often tells nothing
        self.words = [word() for _ in range(40_000)]
        # on a page without names, what is said tells an advert from a paragraph
        self.plain = False

    def one(self, *options):
        return options[self.r.randrange(len(options))]

    def said(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        kind = self.r.random()
        if not self.plain and kind < 0.1:
            # under a telling name main text may say anything
            own = self.SAID[self.one(*self.SAID)].split()
            words = [self.r.choice(own) for _ in words]
        if self.r.random() < 0.5:
            words[0] = words[0].capitalize()
        if kind > 0.95:
            return self.one(" | ", " - ", " / ", ", ").join(words) + self.one("", " |", ".")
        end = self.one(".", ".", ".", "", "!", "?", ":")
        return " ".join(words) + end

    def aside(self, role: str, low: int, high: int) -> str:
        """What a block that isn't main text says: mostly its role's words, the more so where no name tells it."""
        share = 0.9 if self.plain else self.one(0.0, 0.3, 0.7)
        own = self.SAID[role].split()
        words = [self.r.choice(own) if self.r.random() < share else self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.6:
            words[0] = words[0].capitalize()
        return " ".join(words) + self.one(".", ".", "", "!")

    def little(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.r.choices(self.STOCK, k=self.r.randint(low, high))) if self.r.random() < 0.4 else self.said(low, high).rstrip(".")

    def named(self, role: str) -> str:
        kind = self.r.random()
        if self.plain:
            return "" if kind < 0.7 else f' class="{self.one("x", "c", "row", "col", "box", "block", "item")}{self.r.randrange(99)}"'
        word = self.r.choice((self.ROLES.get(role) or self.MAIN).split())
        word = self.one(word, f"site-{word}", f"{word}-{self.r.randrange(9)}", f"{word} c{self.r.randrange(99)}", f"{word}_box", f"the-{word}")
        return f' class="{word}"' if kind < 0.6 else f' id="{word}"' if kind < 0.8 else f" class='x{self.r.randrange(99)}'" if kind < 0.9 else ""

    def listed(self) -> str:
        link = lambda: self.one(f'<a href="/{self.r.randrange(99)}">{self.little()}</a>', f'<a href="#">{self.little(1, 7)}</a>')
        n = self.r.randrange(2, 9)
        return self.one(lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(link() for _ in range(n)), lambda: "".join(f"<div>{link()}</div>" for _ in range(n)))()

    def other(self, role: str) -> str:
        tag = {"nav": self.one("nav", "div"), "header": self.one("header", "div"), "footer": self.one("footer", "footer", "div"), "side": self.one("aside", "div"), "comments": self.one("section", "div"), "form": self.one("form", "div"), "notice": self.one("div", "section")}.get(role, self.one("div", "div", "section", "p"))
        name = self.named(role)
        if self.plain:
            tag = self.one("div", "div", "div", "p", "section", "td")
        elif tag == "div" and not re.search("[a-z]{2}", name.partition("=")[2]):
            name = f' class="{self.r.choice(self.ROLES[role].split())}"'
        text = lambda: self.aside(role, 3, 40)
        inner = {
            "nav": self.listed, "header": lambda: f"<h1>{self.little()}</h1>" * (self.r.random() < 0.5) + self.one("", self.listed(), f"<p>{self.little(2, 8)}</p>"),
            "footer": lambda: self.one("&copy; ", "", "<p>") + text() + self.one("", "\n" + text(), self.listed()),
            "side": lambda: f"<h3>{self.little()}</h3>" + self.one(self.listed(), f"<p>{text()}</p>", text()), "ad": lambda: self.one(text(), f"<p>{text()}</p>", f'<a href="/x">{text()}</a>'),
            "notice": lambda: self.one(text(), f"<p>{text()}</p>"), "comments": lambda: f"<h3>{self.little()}</h3>" * (self.r.random() < 0.6) + "".join(f'<{t}{self.one("", self.named("comments"))}>{self.one("<b>" + self.little(1, 2) + "</b>", "")}<p>{self.aside("comments", 3, 60) if self.plain else self.said(3, 80)}</p></{t}>' for t in [self.one("div", "li", "article")] * self.r.randrange(1, 6)),
            "form": lambda: f"<label>{self.little()}</label><input><p>{self.little(2, 9)}</p><button>ok</button>", "share": lambda: self.one(self.listed(), self.little(2, 8)),
        }[role]()
        return f"<{tag}{name}>{inner}</{tag}>"

    def paragraph(self) -> str:
        m, kind = MARK, self.r.random()
        text = self.said(1, 12) if self.r.random() < 0.25 else self.said(8, 150)
        if kind < 0.55:
            return self.one(f"<p>{m}{text}</p>", f"<p>{m}{text}", f"<p>{m}{text}<br>{self.said(2, 20)}</p>", f"<p>{m}<b>{text}<br>", f'<p>{m}{text} <a href="/y">{self.little()}</a> {self.said(2, 9)}</p>')
        if kind < 0.7:
            return f"<{(h := self.one('h2', 'h3'))}>{m}{self.said(1, 8)}</{h}>"
        if kind < 0.8:
            return self.one("<ul>", "<ol>") + "".join(f"<li>{m}{self.said(1, 25)}</li>" for _ in range(self.r.randrange(1, 6))) + self.one("</ul>", "</ol>")
        if kind < 0.86:
            return "<table>" + "".join(f"<tr><td>{m}{self.said(1, 4)}</td><td>{m}{self.said(1, 6)}</td></tr>" for _ in range(self.r.randrange(1, 4))) + "</table>"
        return self.one(f"<blockquote>{m}{text}</blockquote>", f"<pre>{m}{text}</pre>", f"<div>{m}{text}</div>", f"<figure><figcaption>{m}{self.said(2, 12)}</figcaption></figure>", f"<section><p>{m}{text}</p></section>")

    def page(self) -> str:
        """A page of one of the layouts: named parts, parts without telling names, rows of
        a table, or nothing but text."""
        self.plain = False
        kind = self.r.random()
        if kind < 0.5:
            return self.by_names()
        if kind < 0.65:
            return self.bare()
        self.plain = True
        return self.by_words()

    def bare(self) -> str:
        """Main text alone: plain lines, or paragraphs that nothing surrounds."""
        r, n = self.r, self.r.choice([1, 1, 2, 4, 9])
        said = [MARK + self.said(*self.one((1, 5), (2, 60))) for _ in range(n)]
        body = self.one(lambda: "<br>".join(said[:1]), lambda: said[0], lambda: "".join(f"<p>{t}</p>" for t in said), lambda: "".join(f"<p>{t}" for t in said), lambda: "".join(f"<div>{t}</div>" for t in said), lambda: f"<h1>{MARK}{self.said(1, 8)}</h1>" + "".join(f"<p>{t}</p>" for t in said), lambda: "<pre>" + said[0] + "</pre>")()
        head = self.one("", f"<head><title>{self.little()}</title>", f"<head><title>{self.little()}</title></head>")
        return self.one(body, body if "<p" in body else said[0], f"<html>{head}<body>{body}</body></html>", f"<body>{body}", f"<html>{head}{body}") if r.random() < 0.9 else f"<!DOCTYPE html>{body}"

    def by_words(self) -> str:
        """Parts whose elements and names don't tell what they are: a stack of divisions or a table for the layout."""
        r = self.r
        rows = r.random() < 0.4
        parts = [self.one(f"<h1>{MARK}{self.said(1, 10)}</h1>", f"<div>{MARK}{self.said(1, 10)}</div>")] * int(r.random() < 0.8)
        parts += [self.paragraph() if r.random() < 0.6 else f"<div>{MARK}{self.said(6, 120)}</div>" for _ in range(r.choice([1, 2, 3, 5, 8, 14]))]
        if r.random() < 0.35:
            parts.insert(r.randrange(1, len(parts) + 1), self.other(self.one("ad", "share", "side", "form", "notice")))
        body = self.one("", "<div>") + "".join(parts)
        body += "</div>" if body.startswith("<div>") and not parts[0].startswith("<div>") else ""
        before = "".join(self.other(x) for x in ("notice", "header", "nav", "form", "share", "ad") if r.random() < 0.5)
        after = "".join(self.other(x) for x in ("share", "ad", "comments", "side", "form", "footer", "notice") if r.random() < 0.45)
        if rows:
            cells = [c for c in (before, body, after) if c]
            whole = "<table>" + (f"<tr>{''.join(f'<td>{c}</td>' for c in cells)}</tr>" if r.random() < 0.5 else "".join(f"<tr><td>{c}</td></tr>" for c in cells)) + "</table>"
        else:
            whole = before + body + after
        return f"<html><head><title>{self.little()}</title>" + "</head><body>" * int(r.random() < 0.85) + whole + "</body></html>" * int(r.random() < 0.9)

    def by_names(self) -> str:
        r = self.r
        tag = self.one("article", "article", "main", "div", "section")
        name = self.named("main") if tag != "div" else f' class="{r.choice(self.MAIN.split())}"'
        parts = [f"<h1>{MARK}{self.said(1, 10)}</h1>"] * int(r.random() < 0.85) + [self.paragraph() for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25]))]
        if r.random() < 0.2:
            # one line again and again, or many short ones
            again = f"<p>{MARK}{self.said(1, 8)}</p>"
            at = r.randrange(1, len(parts) + 1)
            parts[at:at] = [again if r.random() < 0.8 else f"<p>{MARK}{self.said(1, 6)}</p>" for _ in range(r.randrange(4, 40))]
        if r.random() < 0.3:
            parts.insert(r.randrange(1, len(parts) + 1), self.other(self.one("ad", "share", "side", "form")))
        body = f"<{tag}{name}>{''.join(parts)}" + f"</{tag}>" * int(r.random() < 0.9)
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        has = lambda *roles: "".join(self.other(x) for x in roles if r.random() < 0.5)
        if r.random() < 0.5:
            before, after = self.other("nav") + has("ad"), self.other("footer") * int(r.random() < 0.9)
        else:
            before, after = has("notice", "header", "nav", "form", "share", "ad"), has("share", "ad", "comments", "side", "form") + has("footer", "notice")
        whole = before + body + after
        if r.random() < 0.2:
            whole = f'<div class="{self.one("wrapper", "container", "layout", "page")}">{whole}</div>'
        return f"<html><head><title>{self.little()}</title></head><body>{whole}" + "</body></html>" * int(r.random() < 0.9)


def labelled(page: str) -> tuple[list, np.ndarray]:
    """Blocks of a generated page, their marks taken out, and labels."""
    found = blocks(page)
    return [(p, t.replace(MARK, "").strip() or "x", s) for p, t, s in found], np.array([MARK in t for _, t, _ in found], np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> Labeller:
    """A labeller trained on generated pages by Adam; the same each time."""
    make, model, buckets = _Pages(seed), Labeller(seed), Words()
    params = [model.ahead.p, model.back.p, model.top, model.words]
    moment = [{k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()} for p in params]
    steps = max(1, pages // BATCH_PAGES)
    for step in range(1, steps + 1):
        batch = [(features(b, buckets), y) for b, y in (labelled(make.page()) for _ in range(BATCH_PAGES)) if b]
        _, grads = model.step([x for x, _ in batch], [y for _, y in batch])
        norm = np.sqrt(sum(float((g**2).sum()) for gs in grads for g in gs.values()))
        rate = RATE * (0.1 + 0.9 * (1 - step / steps))
        for p, gs, ms in zip(params, grads, moment):
            for k, g in gs.items():
                g = g / max(1.0, norm)
                m, v = ms[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


#: Blocks of one numpy call, padding included.
CALL_BLOCKS = 20_000


def main_texts(pages: list[str | None], model: Labeller, buckets: Words) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) for p in pages]
    out, order, at = [""] * len(pages), sorted((k for k, f in enumerate(found) if f), key=lambda k: len(found[k])), 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(found[order[stop]]) <= CALL_BLOCKS:
            stop += 1
        part = order[at:stop]
        for k, p in zip(part, model.probabilities([features(found[k], buckets) for k in part])):
            out[k] = " ".join(t for (_, t, _), q in zip(found[k], p) if q >= 0.5)
        at = stop
    return out


def extract(pages: DataFrame, model: Labeller | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row.

    A null or empty page and one without main text give an empty text, an empty table an
    empty one. Rows are labelled one by one, whatever else their batch holds: repeated
    rows give equal results. A page of any length or depth takes time and memory in
    proportion to it; other columns, whatever their names, aren't read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Words()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = main_texts(part.column(2).to_pylist(), shared.value, buckets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(label, "page_id long, url string, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
