"""HTML extraction with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in page
order.  Each block becomes a vector of its tag path (tag names and words of
class, id and role, hashed), all its words (hashed) and a few measures; a
bidirectional LSTM in numpy reads the page's blocks and labels each as main
text or not, so a block is judged by the whole page.

The model is trained here, on pages that ``synthetic_page`` makes up with a
fixed seed; it takes seconds and needs no table.

Defined results: a null or empty html and a page without main text give an
empty text; broken markup is read as far as it goes, and end tags that HTML
lets authors leave out may be left out; elements nested deeper than DEEPEST
count as siblings; a page of any length is read whole, in time and memory that
grow with its length; repeated rows are each extracted; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import or_empty, read_table, small_batches

# HTML elements by their role in cutting a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg canvas title head textarea audio video".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>""", re.S)
NAMED = re.compile(r"""(?i)(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
WORDS = re.compile(r"[a-z]+")
BREAKS = re.compile(r"(?<=[a-z])(?=[A-Z])")


PATH_DIM, WORD_DIM, MEASURES = 96, 32, 9
DIM = PATH_DIM + WORD_DIM + MEASURES
DEEPEST = 256  # elements below that depth count as siblings, as browsers have it at a depth of their own
SEGMENT = 4096  # blocks of a long page that are held as vectors at once


class Block:
    __slots__ = ("path", "parts", "linked")

    def __init__(self, path: tuple) -> None:
        self.path, self.parts, self.linked = path, [], 0


@functools.lru_cache(50_000)
def _path_places(token: str) -> tuple[tuple[int, int], ...]:
    hashes = (zlib.crc32(salt + token.encode()) for salt in (b"a", b"b", b"c"))
    return tuple((h % PATH_DIM, 1 if h >> 31 else -1) for h in hashes)


class Path:
    """The open elements as a hashed vector of their names and the words that authors gave them, each counted once."""

    def __init__(self) -> None:
        self.vector, self.times, self.names = array("h", bytes(2 * PATH_DIM)), {}, []
        self.kept, self.same = None, {}

    def add(self, name: str, words: tuple) -> None:
        self.names.append(name)
        for token in (f"in {name}", *(f"is {w}" for w in set(words))):
            n = self.times.get(token, 0)
            self.times[token] = n + 1
            if not n:
                for place, sign in _path_places(token):
                    self.vector[place] += sign
        self.kept = None

    def remove(self, name: str, words: tuple) -> None:
        self.names.pop()
        for token in (f"in {name}", *(f"is {w}" for w in set(words))):
            n = self.times[token]
            if n > 1:
                self.times[token] = n - 1
            else:
                del self.times[token]
                for place, sign in _path_places(token):
                    self.vector[place] -= sign
        self.kept = None

    def now(self) -> tuple[int, bytes]:
        """Depth and vector, with the innermost element marked; equal ones of a page are one object."""
        if self.kept is None:
            out = array("h", self.vector)
            for place, sign in _path_places(f"leaf {self.names[-1]}" if self.names else "bare"):
                out[place] += sign
            made = (len(self.names), out.tobytes())
            self.kept = self.same.setdefault(made, made)
        return self.kept


def blocks(page: str) -> list[tuple[tuple[int, bytes], str, float]]:
    """(path, text, share of the text in links) of each leaf block in page order, in time that grows with the page's length."""
    stack: list[tuple[str, tuple]] = []
    deeper: dict[str, int] = {}  # open elements beyond DEEPEST or within hidden ones
    done: list[Block] = []
    now: Block | None = None
    at, hidden, links, path = 0, 0, 0, Path()
    last = page.rfind(">") + 1

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if hidden and stack[-1][0] == "head" and not raw.isspace():
            pop_to(len(stack) - 1)
        if hidden:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(path.now())
            done.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    def pop_to(k: int) -> None:
        nonlocal hidden, links, now
        while len(stack) > k:
            name, words = stack.pop()
            hidden -= name in HIDDEN
            links -= name == "a"
            if name not in INLINE:
                now = None
            if name not in INLINE or words:
                path.remove(name, words)
        deeper.clear()

    while at < len(page):
        found = TOKEN.search(page, at, last) if at < last else None
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["end"]:
            if deeper.get(name):
                deeper[name] -= 1
                if name not in INLINE:
                    now = None
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            else:
                if name not in INLINE:
                    now = None
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            pop_to(len(stack) - 1)
        elif name == "body":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "head":
                    pop_to(k)
                    break
        if name == "br":
            text(" ")
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif name in SAME:
            k = len(stack) - 1
            while k >= 0 and (stack[k][0] in INLINE or stack[k][0] == "p"):
                k -= 1
            if k >= 0 and stack[k][0] in SAME[name]:
                while k > 0 and stack[k - 1][0] in SAME[name] and name != stack[k][0]:
                    k -= 1
                pop_to(k)
        if name not in INLINE:
            now = None
        if name in VOID or found["rest"].endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            close = _close_of(name).search(page, at)
            at = close.start() if close else len(page)
        if len(stack) >= DEEPEST and name not in HIDDEN or hidden and stack[-1][0] != "head":
            deeper[name] = deeper.get(name, 0) + 1
            continue
        words = tuple(w for v in NAMED.findall(found["rest"]) for w in WORDS.findall(BREAKS.sub(" ", v).lower())) if "=" in found["rest"] else ()
        stack.append((name, words))
        hidden += name in HIDDEN
        links += name == "a"
        if name not in INLINE or words:
            path.add(name, words)
    out = []
    for b in done:
        raw = "".join(b.parts)
        whole = " ".join(html_lib.unescape(raw).split())
        if whole:
            out.append((b.path, whole, min(1.0, b.linked / max(1, len(raw)))))
    return out


@functools.lru_cache(100)
def _close_of(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{name}")


# Vectors


_WORD_CODES: dict[str, int] = {}


def _word_code(word: str) -> int:
    """Place of a word among WORD_DIM, plus WORD_DIM where it counts down."""
    code = _WORD_CODES.get(word)
    if code is None:
        if len(_WORD_CODES) > 200_000:
            _WORD_CODES.clear()
        h = zlib.crc32(word.strip(".,:;!?()\"'").encode())
        code = _WORD_CODES[word] = h % WORD_DIM + WORD_DIM * (h >> 31)
    return code


def vectors(page: list[tuple[tuple[int, bytes], str, float]], start: int = 0, stop: int | None = None, total: int = 0) -> np.ndarray:
    """The vectors of the page's blocks from start to stop; each takes in all words of its block. total: characters of the page, if known."""
    part = page[start:stop]
    out = np.zeros((len(part), DIM), np.float32)
    if not part:
        return out
    total = total or max(1, sum(len(t) for _, t, _ in page))
    out[:, :PATH_DIM] = np.frombuffer(b"".join(path[1] for path, _, _ in part), np.int16).reshape(len(part), PATH_DIM)
    split = [text.lower().split() for _, text, _ in part]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.fromiter((_word_code(w) for words in split for w in words), np.int64, int(sizes.sum()))
    counts = np.bincount(np.repeat(np.arange(len(part)), sizes) * (2 * WORD_DIM) + codes, minlength=len(part) * 2 * WORD_DIM).reshape(len(part), 2, WORD_DIM)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = (counts[:, 0] - counts[:, 1]) / sizes[:, None]
    for k, ((path, text, linked), words) in enumerate(zip(part, split)):
        out[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 4, linked, (start + k) / max(1, len(page)), text[-1] in ".!?\"'”»", path[0] / 8, len(text) / total,
            (len(text) - len(words) + 1) / len(words) / 10, text.startswith(("©", "(c)")), 1.0,
        )
    return out


# Bidirectional LSTM


class Labeller:
    """One LSTM each way; a block's logit is linear in both states and in its vector."""

    def __init__(self, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        init = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {f"{k}{d}": init(*s) for d in "fb" for k, s in (("x", (DIM, 4 * hidden)), ("h", (hidden, 4 * hidden)), ("c", (4 * hidden,)))}
        self.p |= {"of": init(hidden), "ob": init(hidden), "ox": init(DIM) * 0, "o": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"c{d}"][hidden : 2 * hidden] += 1.0  # remember at first

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, before: tuple | None = None):
        n, t, _ = x.shape
        h, c = before or (np.zeros((n, self.h), np.float32),) * 2
        states, tape, size = np.zeros((n, t, self.h), np.float32), [], self.h
        inputs = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = inputs[:, k] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * size], -30, 30)))
            i, f, o, g = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :], np.tanh(z[:, 3 * size :])
            m = mask[:, k, None]
            new = f * c + i * g
            after = np.tanh(new)
            if keep:
                tape.append((k, h, c, i, f, o, g, after, m))
            c = m * new + (1 - m) * c
            h = m * (o * after) + (1 - m) * h
            states[:, k] = h
        self.last = (h, c)
        return states, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(x, mask, "f", False)
        b, _ = self._run(x, mask, "b", False)
        return 1 / (1 + np.exp(-np.clip(f @ self.p["of"] + b @ self.p["ob"] + x @ self.p["ox"] + self.p["o"], -30, 30)))

    def long_page(self, page: list, segment: int = SEGMENT) -> np.ndarray:
        """Probabilities of the blocks of one page; the states go from segment to segment, so no more than one is held as vectors."""
        z, total = np.zeros(len(page), np.float32), max(1, sum(len(t) for _, t, _ in page))
        for d in "fb":
            state = None
            cuts = range(0, len(page), segment)
            for k in cuts if d == "f" else reversed(cuts):
                x = vectors(page, k, k + segment, total)[None]
                states, _ = self._run(x, np.ones(x.shape[:2], np.float32), d, False, state)
                state = self.last
                z[k : k + segment] += (states @ self.p[f"o{d}"])[0]
                if d == "f":
                    z[k : k + segment] += (x @ self.p["ox"])[0] + self.p["o"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        z = runs["f"][0] @ self.p["of"] + runs["b"][0] @ self.p["ob"] + x @ self.p["ox"] + self.p["o"]
        p, n = 1 / (1 + np.exp(-z)), mask.sum()
        e = (p - y) * mask / n
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"][0], g["ox"] = e.sum(), np.einsum("nt,ntd->d", e, x)
        for d, (states, tape) in runs.items():
            g[f"o{d}"] = np.einsum("nt,nth->h", e, states)
            dh = dc = np.zeros((len(x), self.h), np.float32)
            dz_all = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
            for k, h, c, i, f, o, q, after, m in reversed(tape):
                dh = dh + e[:, k, None] * self.p[f"o{d}"]
                dnew = m * (dh * o * (1 - after * after) + dc)
                dz = np.concatenate([dnew * q * i * (1 - i), dnew * c * f * (1 - f), m * dh * after * o * (1 - o), dnew * i * (1 - q * q)], 1)
                dz_all[:, k] = dz
                g[f"h{d}"] += h.T @ dz
                dh = dz @ self.p[f"h{d}"].T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            g[f"x{d}"] = np.einsum("ntd,ntz->dz", x, dz_all)
            g[f"c{d}"] = dz_all.sum((0, 1))
        return loss, g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), longest, DIM), np.float32), np.zeros((len(pages), longest), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


# Training pages

# Names that page authors give to the parts of a page.
MAIN_NAMES = "content article post entry story body main text story-body article-content post-content entry-content page-content".split()
OTHER_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs links toc tabs skip".split(),
    "header": "header masthead top site-header banner logo branding".split(),
    "footer": "footer site-footer colophon copyright legal bottom".split(),
    "sidebar": "sidebar aside rail widget related recommended popular trending more side".split(),
    "notice": "cookie cookies notice consent gdpr alert cookie-banner privacy popup modal newsletter subscribe overlay paywall".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo ad-slot banner-ad adsense".split(),
    "form": "form search login signup contact search-form".split(),
    "comments": "comments comment replies reply discussion disqus respond comment-list reader-comments".split(),
    "share": "share social sharing buttons tags meta byline".split(),
}


# Words that stand in the parts of a page other than its main text.
OTHER_WORDS = {
    "menu": "home about contact news sports business products services blog shop archive categories help faq sitemap next previous".split(),
    "header": "welcome your daily source for news and stories since today edition magazine online".split(),
    "footer": "copyright all rights reserved terms of use privacy policy imprint contact us powered by".split(),
    "sidebar": "related articles read more recommended for you popular posts trending now recent most viewed tags archive".split(),
    "notice": "we use cookies to improve your experience accept all reject settings privacy consent subscribe to our newsletter sign up for free enter email notice alert".split(),
    "ad": "advertisement sponsored buy now save off today only offer sale limited deal shop order discount free shipping click here".split(),
    "form": "search log in sign up email password name message submit send register username remember me".split(),
    "comments": "comments reply says wrote posted ago great post thanks for sharing i agree nice article leave a comment guest user".split(),
    "share": "share on tweet facebook email print by author published updated minutes read follow us".split(),
}


def synthetic_page(rng: random.Random) -> str:
    """A made-up page; main text carries the mark ¶ in each block.

    Words are made of syllables; in most pages those of the other parts are
    mixed with the words that such parts have; now and then some of these stand
    in main text, and a block is one word over and over.
    """
    syllables = "a be ci do en fa ge hi ou the tion ing er le que ment ung ver an el ar os ri né ß st nd".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    telling = rng.random() < 0.7
    every = [w for known in OTHER_WORDS.values() for w in known]
    part: list[str] = []

    def words(lo: int, hi: int) -> str:
        known, often = (OTHER_WORDS[part[-1]], 0.6) if part else (every, 0.05)
        n, kind = rng.randint(lo, hi), rng.random()
        if kind < 0.04:
            s = " ".join([word()] * n)
        elif kind < 0.08 and not part:
            s = " ".join(rng.choice(every) for _ in range(n))
        else:
            s = " ".join(rng.choice(known) if telling and rng.random() < often else word() for _ in range(n))
        return s.capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def name(names: list[str], p: float = 0.9) -> str:
        if rng.random() > p:
            return f' class="{word()}"' if rng.random() < 0.5 else ""
        extra = f" {word()}" if rng.random() < 0.3 else ""
        return f' {rng.choice(["class", "class", "class", "id"])}="{rng.choice(names)}{extra}"'

    def paragraphs(n: int, mark: str) -> str:
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.72:
                inner = words(1, rng.choice([3, 20, 60, 60])) if rng.random() < 0.9 else f"<b>{words(1, 9)}<br>"
                if rng.random() < 0.15:
                    inner += f' <a href="#">{words(1, 4)}</a>'
                out.append(f"<p>{mark}{inner}" + ("</p>" if rng.random() < 0.85 else ""))
            elif kind < 0.8:
                out.append(f"<h{(h := rng.randint(2, 4))}>{mark}{words(1, 8)}</h{h}>")
            elif kind < 0.88:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{mark}{words(1, 15)}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.92:
                out.append(f"<blockquote>{mark}{words(4, 30)}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f"<pre>{mark}{words(3, 20)}</pre>")
            else:
                out.append(f"<figure><img src='x'><figcaption>{mark}{words(2, 12)}</figcaption></figure>")
        return "".join(out)

    def list_of_links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi))) + "</ul>"

    def other(kind: str) -> str:
        part.append(kind)
        out = other_part(kind)
        part.pop()
        return out

    def other_part(kind: str) -> str:
        tags = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "ad": ["div", "aside", "section", "ins"], "form": ["form", "div"], "comments": ["section", "div"], "share": ["div", "ul"]}
        tag = rng.choice(tags[kind])
        plain = tag in ("nav", "header", "footer", "aside", "form")
        if kind == "menu":
            inner = list_of_links(3, 9) if tag != "ul" else "".join(f'<li><a href="#">{words(1, 2)}</a></li>' for _ in range(5))
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button>" + (f"<p>{words(2, 15)}</p>" if rng.random() < 0.5 else "")
            tag = "form" if rng.random() < 0.8 else tag
        elif kind == "comments":
            inner = f"<h3>{words(1, 3)}</h3>" + "".join(f'<{(e := rng.choice(["div", "li", "article"]))} class="comment"><{(a := rng.choice(["span", "div", "h4"]))} class="author">{words(1, 2)}</{a}><p>{words(3, 60)}</p></{e}>' for _ in range(rng.randint(1, 6)))
        elif kind == "footer":
            inner = rng.choice(["", f"<p>{words(3, 25)}</p>"]) + f"&copy; {words(1, 14)}" + rng.choice(["", list_of_links(2, 5)])
        elif kind in ("sidebar", "share"):
            inner = f"<h3>{words(1, 4)}</h3>" + rng.choice([list_of_links(2, 7), paragraphs(rng.randint(1, 3), ""), f"<div>{words(3, 30)}</div>"])
        elif kind == "header":
            inner = rng.choice([f"<h1>{words(1, 5)}</h1>", f'<div class="logo"><a href="/">{words(1, 3)}</a></div>', words(1, 6)]) + rng.choice(["", f"<p>{words(2, 10)}</p>", other("menu")])
        else:
            inner = rng.choice([words(2, 25), f"<p>{words(2, 40)}</p>", f"<p>{words(2, 12)}</p><button>{words(1, 2)}</button>", f'<a href="#">{words(2, 9)}</a>'])
        return f"<{tag}{name(OTHER_NAMES[kind], 0.35 if plain and kind != 'notice' and kind != 'ad' else 1.0)}>{inner}</{tag}>"

    def main() -> str:
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        inner = f"<h1>¶{words(1, 12)}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 4)):
            inner += paragraphs(rng.randint(1, 7), "¶")
            if rng.random() < 0.25:
                inner += other(rng.choice(["ad", "ad", "sidebar", "form", "notice", "share"]))
        if rng.random() < 0.1:
            inner += other("comments")
        body = f"<{tag}{name(MAIN_NAMES, 0.3 if tag in ('article', 'main') else 1.0)}>{inner}</{tag}>"
        return f"<div{name(MAIN_NAMES, 0.5)}>{body}</div>" if rng.random() < 0.25 else body

    first = [other(k) for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.8), ("ad", 0.4), ("form", 0.15)) if rng.random() < p]
    rng.shuffle(first)
    last = [other(k) for k, p in (("sidebar", 0.4), ("comments", 0.4), ("ad", 0.2), ("form", 0.2), ("notice", 0.15), ("share", 0.2)) if rng.random() < p]
    rng.shuffle(last)
    middle = paragraphs(rng.randint(1, 9), "¶") if rng.random() < 0.08 else main()
    page = "".join(first) + middle + "".join(last) + (other("footer") if rng.random() < 0.85 else "")
    for _ in range(rng.choice([0, 0, 1, 2])):
        page = f"<div{name(['wrapper', 'container', 'page', 'site', 'row', 'layout'])}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>"


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        page = blocks(synthetic_page(rng))
        if page:
            y = np.array([text.startswith("¶") for _, text, _ in page], np.float32)
            out.append((vectors([(p, t.removeprefix("¶") or ".", a) for p, t, a in page]), y))
    return out


@functools.lru_cache(1)
def trained(pages: int = 1000, epochs: int = 15, hidden: int = 16, seed: int = 7) -> Labeller:
    """The model, by Adam; its weights are the mean over the last third of the steps, which settles the chance of where the last step ends."""
    data, model, rng = examples(pages, seed), Labeller(hidden, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    mean, turn, late = {k: np.zeros_like(v) for k, v in model.p.items()}, 0, 0
    order = sorted(range(len(data)), key=lambda k: len(data[k][0]))
    parts = [order[k : k + 30] for k in range(0, len(order), 30)]
    for epoch in range(epochs):
        for k in rng.permutation(len(parts)):
            x, mask = padded([data[i][0] for i in parts[k]])
            # In a third of the pages words tell nothing, so that paths and measures are learnt as well.
            x[rng.random(len(x)) < 1 / 3, :, PATH_DIM : PATH_DIM + WORD_DIM] = 0
            y = np.zeros(mask.shape, np.float32)
            for r, i in enumerate(parts[k]):
                y[r, : len(data[i][1])] = data[i][1]
            _, g = model.slopes(x, mask, y)
            turn += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for name, v in model.p.items():
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
                v -= (rate * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
            if 3 * epoch >= 2 * epochs:
                late += 1
                for name, v in model.p.items():
                    mean[name] += (v - mean[name]) / late
    model.p = mean
    return model


def main_texts(pages: list[str], model: Labeller, chunk: int = 64) -> list[str]:
    """The main text of each page; pages of like length share a padded batch, of at most so many blocks in all."""
    cut = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if cut[k]), key=lambda k: len(cut[k]))
    k = 0
    while k < len(order):
        part = order[k : k + chunk]
        while len(part) > 1 and len(part) * len(cut[part[-1]]) > SEGMENT:
            part = part[: len(part) // 2]
        k += len(part)
        p = [model.long_page(cut[part[0]])] if len(cut[part[-1]]) > SEGMENT else model.probabilities(*padded([vectors(cut[i]) for i in part]))
        for r, i in enumerate(part):
            out[i] = "\n\n".join(text for (_, text, _), good in zip(cut[i], p[r] >= 0.5) if good)
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    import pyarrow as pa

    small_batches(pages.sparkSession)

    def run(batches):
        for batch in W.batches_of(batches, 1 << 20):
            texts = main_texts(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", or_empty("html").alias("text"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), trained())
