"""Main text of web pages by a recurrent block labeller (operator 8).

A page becomes the sequence of its leaf blocks.  Each block is a vector: its tag path with class words, hashed; all of its own
words, hashed; and a few numbers.  A bidirectional LSTM written in numpy reads the whole sequence, so that what stands
before and after a block counts, and labels every block as main text or not.  It is trained here, on pages that this module
writes itself; training is seeded and needs no table.

A page may be of any length and nesting: the path is a running vector, open elements are found by tag, and the sequence is read in
parts, between which only the LSTM's state is carried.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrafold.llm.common import CACHES, map_rows, table

#: Parameters: sizes of the hashed path and word vectors, of the state of each direction, pages to train on, rounds, and blocks of a part of a padded group.
PATH, WORDS, STATE, TRAIN_PAGES, ROUNDS, GROUP_BLOCKS = 64, 128, 16, 3600, 10, 8_192
#: Parameter: share by which weights of words shrink at each step of training.
WORD_DECAY = 0.05

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[a-z]+")
#: HTML's elements by how they are read.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, up to the elements at which that stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NO_P = BLOCK - {"button", "label", "option", "optgroup", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}


@dataclass(slots=True)
class Block:
    path: bytes  # PATH numbers of 32 bits
    text: str
    linked: int


@functools.lru_cache(maxsize=20_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag's own name, and the words of its class, id and role."""
    out = [tag]
    if "=" in attributes:
        for _, value in _ATTRIBUTE.findall(attributes):
            out += [f".{w}" for w in _PART.findall(value.lower())]
    return tuple(dict.fromkeys(out))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: runs of text with no block element's tag inside.

    Scripts, styles, titles and comments are not text.  Character references are decoded; white space becomes one space.
    Tags that stay open or close nothing are read as browsers do in the common cases.
    """
    page = page or ""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(opened.path(), text, min(linked, len(text))))
            linked = 0

    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            if opened.places.get("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m[1]:
            index = opened.nearest((tag,))
            if index >= 0:
                if opened.holds_block(index):
                    flush()
                opened.close(index)
            continue
        if tag in RAW:
            stop = _raw_end(tag).search(page, at)
            at = stop.start() if stop else end
            tail = page.find(">", at)
            at = end if not stop or tail < 0 else tail + 1
            continue
        if tag in VOID:
            continue
        shut, until = CLOSES[tag] if tag in CLOSES else (("p",), ("button", "table")) if tag in _NO_P else ((), ())
        while (index := opened.nearest(shut)) > opened.nearest(until):
            opened.close(index)
            if tag != "tr":
                break
        if not m[0].endswith("/>"):
            opened.add(tag, _names(tag, m[3] or ""))
    flush()
    return out


class _Open:
    """Elements that are open: places by tag, so that the nearest one is found at any depth, and the running vector of their names."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.counts: dict[str, int] = {}
        self.vector = array("i", bytes(4 * PATH))
        self.known: dict[bytes, bytes] = {}

    def nearest(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost element of any of ``tags``, or -1."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def holds_block(self, index: int) -> bool:
        """Whether a block element is among those from ``index`` on."""
        return bool(self.blocks) and self.blocks[-1] >= index

    def add(self, tag: str, names: tuple[str, ...]) -> None:
        place = len(self.stack)
        self.stack.append((tag, names))
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        self._count(names, 1)

    def close(self, index: int) -> None:
        """Close the element at ``index`` and all inside it."""
        while len(self.stack) > index:
            tag, names = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self._count(names, -1)

    def _count(self, names: tuple[str, ...], step: int) -> None:
        for n in names:
            was = self.counts.get(n, 0)
            self.counts[n] = was + step
            if not was or not was + step:  # a name counts once, however often it is open
                i, sign = _slot(n, PATH)
                self.vector[i] += sign * step

    def path(self) -> bytes:
        own = self.vector.tobytes()
        return self.known.setdefault(own, own)


@functools.lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def _hashed(name: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h % size, 1 if (h >> 16) & 1 else -1


_slot = functools.lru_cache(maxsize=50_000)(_hashed)


class _Words(dict):
    """Place and sign of each word as one number: the place, from WORDS on for a negative sign."""

    def __missing__(self, word: str) -> int:
        i, sign = _hashed(word.strip(".,:;!?"), WORDS)
        self[word] = n = i if sign > 0 else i + WORDS
        return n


_words = _Words()


def forget() -> None:
    for cached in (_names, _slot, _raw_end):
        cached.cache_clear()
    _words.clear()


CACHES[__name__] = forget
NUMBERS = 8


def vectors(own: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row for each block; ``own`` stands from ``first`` on in a page of ``total`` blocks."""
    total = len(own) if total is None else total
    x = np.zeros((len(own), PATH + WORDS + NUMBERS), np.float32)
    if len(_words) > 300_000:
        _words.clear()
    number = _words.__getitem__
    for i, b in enumerate(own, first):
        row = x[i - first]
        row[:PATH] = np.frombuffer(b.path, np.int32)
        words = b.text.lower().split()
        hits = np.bincount(np.fromiter(map(number, words), np.int64, len(words)), minlength=2 * WORDS)
        told = hits[:WORDS] - hits[WORDS:]
        row[PATH : PATH + WORDS] = told / max(1.0, np.sqrt(float(told @ told)))
        n, chars = len(words), len(b.text)
        row[PATH + WORDS :] = [np.log1p(n) / 4, np.log1p(chars) / 6, b.linked / chars, b.text[-1] in ".!?", i / total, (total - i) / total, n < 4, b.text[0] in "©|»›"]
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class BlockLabeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, inputs: int = PATH + WORDS + NUMBERS, state: int = STATE, seed: int = 3):
        r = np.random.default_rng(seed)
        self.state = state
        self.p = {"out": r.normal(0, 0.3, (2 * state, 1)), "skip": np.zeros((inputs, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * state))
            self.p[f"h{d}"] = r.normal(0, 1 / np.sqrt(state), (state, 4 * state))
            self.p[f"c{d}"] = np.concatenate([np.zeros(state), np.ones(state), np.zeros(2 * state)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, carried: list | None = None) -> np.ndarray:
        """States of one direction for (time, page, input); places beyond a page's end leave the state as it is.

        carried: state and cell before the first place, replaced by those after the last one.
        """
        n, s = x.shape[1], self.state
        h, c = carried or (np.zeros((n, s), np.float32), np.zeros((n, s), np.float32))
        out = np.zeros((len(x), n, s), np.float32)
        fed = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = fed[t] + h @ self.p[f"h{d}"]
            i, f, o, g = _sigmoid(z[:, :s]), _sigmoid(z[:, s : 2 * s]), _sigmoid(z[:, 2 * s : 3 * s]), np.tanh(z[:, 3 * s :])
            m = mask[t][:, None]
            c1 = m * (f * c + i * g) + (1 - m) * c
            h1 = m * (o * np.tanh(c1)) + (1 - m) * h
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, c1, m))
            h, c, out[t] = h1, c1, h1
        if carried is not None:
            carried[:] = [h, c]
        return out

    def margins(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kept = {d: [] if keep is not None else None for d in "fb"}
        both = np.concatenate([self._read(x, mask, d, kept[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"both": both, **kept}
        return (both @ self.p["out"] + x @ self.p["skip"])[:, :, 0] + self.p["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        dz = ((_sigmoid(self.margins(x, mask, keep)) - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["skip"], g["bias"] = np.einsum("tns,tno->so", keep["both"], dz), np.einsum("tni,tno->io", x, dz), dz.sum((0, 1))
        dboth, s = dz @ self.p["out"].T, self.state
        for k, d in enumerate("fb"):
            dh = dc = np.zeros((x.shape[1], s), np.float32)
            for t, h, c, i, f, o, gg, c1, m in reversed(keep[d]):
                dh = dh + dboth[t, :, k * s : (k + 1) * s]
                th = np.tanh(c1)
                own, cell = m * dh, dc + m * dh * o * (1 - th * th)
                live = m * cell
                z = np.concatenate([live * gg * i * (1 - i), live * c * f * (1 - f), own * th * o * (1 - o), live * i * (1 - gg * gg)], axis=1)
                g[f"x{d}"] += x[t].T @ z
                g[f"h{d}"] += h.T @ z
                g[f"c{d}"] += z.sum(0)
                dh, dc = (1 - m) * dh + z @ self.p[f"h{d}"].T, live * f + (1 - m) * cell
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.02, seed: int = 5) -> BlockLabeller:
        """Adam over shuffled groups of pages of similar length."""
        r, first, second, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        for _ in range(rounds):
            for k in r.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for col, i in enumerate(groups[k]):
                    y[: len(pages[i][1]), col] = pages[i][1]
                step += 1
                for name, grad in self.gradients(x, mask, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad * grad
                    if name in ("xf", "xb", "skip"):  # what words say counts only where it pays
                        self.p[name][PATH : PATH + WORDS] *= 1 - WORD_DECAY
                    self.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text.  Pages go in groups of similar length; longer ones are read in parts."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= GROUP_BLOCKS and n < 512:
                n += 1
            group, order = order[:n], order[n:]
            z = self.scores([pages[k] for k in group])
            for col, k in enumerate(group):
                out[k] = z[: len(pages[k]), col] > 0
        return out

    def scores(self, group: list[list[Block]], most: int = GROUP_BLOCKS) -> np.ndarray:
        """Margins (place, page).  Vectors and states exist for a part of at most ``most`` blocks at once."""
        longest, step, s = max(map(len, group)), max(1, most // len(group)), self.state
        z = np.full((longest, len(group)), self.p["bias"][0], np.float32)
        starts = range(0, longest, step)
        part = lambda t: padded([vectors(p[t : t + step], t, len(p)) for p in group])
        whole = part(0) if len(starts) == 1 else None
        for k, d in enumerate("fb"):
            carried = [np.zeros((len(group), s), np.float32) for _ in range(2)]
            for t in starts if d == "f" else reversed(starts):
                x, mask = whole or part(t)
                z[t : t + len(x)] += (self._read(x, mask, d, None, carried) @ self.p["out"][k * s : (k + 1) * s])[:, :, 0]
                if d == "f":
                    z[t : t + len(x)] += (x @ self.p["skip"])[:, :, 0]
        return z


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32), np.zeros((longest, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


#: What notices and the like say, in the languages of the pages.  Only the training pages use them.
PHRASES = {
    "notice": ["We use cookies to improve this site.", "This site uses cookies. Accept all cookies?", "By going on you accept our privacy policy.", "Diese Seite nutzt Cookies.", "Nous utilisons des cookies.", "Usamos cookies en este sitio."],
    "advert": ["Advertisement", "Sponsored content", "Buy now and save.", "Special offer: order today!", "Anzeige", "Publicité", "Publicidad"],
    "aside": ["Related articles", "Most read", "You may also like", "Follow us on social media", "Share this article", "Mehr zum Thema", "À lire aussi", "Lo más leído"],
    "form": ["Subscribe to our newsletter", "Sign up with your email", "Log in", "Your password", "Search this site", "Newsletter abonnieren", "Rechercher", "Buscar"],
    "comment": ["Leave a reply", "2 comments", "Reply to this comment", "Great article, thanks for sharing!", "I disagree.", "Kommentar schreiben", "Laisser un commentaire", "Deja un comentario"],
    "foot": ["All rights reserved.", "Terms of use, privacy, contact", "Copyright", "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados"],
}


def training_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page in one of many layouts, and for each of its blocks whether it is main text."""
    letters = "etaoinshrdlucmfwypvbgkéèüßñçó"
    spell = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 10)))
    few = [spell() for _ in range(r.choice([1, 3, 10, 30, 100, 300]))]  # a page's own words, some of which are frequent
    word = lambda: few[int(len(few) * r.random() ** 2)] if r.random() < 0.8 else spell()
    style = r.random()

    def prose(low: int, high: int) -> str:
        own = [word() for _ in range(r.randint(low, high))]
        if style < 0.1:
            own = [w.upper() + "!!" for w in own]
        elif style < 0.2:
            own = [w + r.choice(["***", "$$$", "###", "&amp;&amp;&amp;", "%%%"]) for w in own]
        elif style < 0.3:
            own = [w + r.choice([" |", ""]) for w in own]
        return " ".join(own).capitalize() + r.choice([".", ".", ".", "", "!"])

    def phrase(kind: str, low: int, high: int) -> str:
        """Words as boilerplate has them, prose, or both."""
        how = r.random()
        own = r.choice(PHRASES[kind]) if how < 0.7 else ""
        return own if how < 0.35 else f"{own} {prose(low, high)}".strip()

    out, truth = [], []

    def add(markup: str, *labels: bool) -> None:
        out.append(markup)
        truth.extend(labels)

    cls = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'])
    links = lambda n: "".join(f'<li><a href="/{word()}">{prose(1, 3)}</a></li>' for _ in range(n))

    def menu() -> None:
        n = r.randint(1, 8)
        form = r.choice(["<nav><ul>{}</ul></nav>", f"<div{cls('menu', 'nav', 'navbar', 'navigation', 'topnav', 'breadcrumb')}><ul>{{}}</ul></div>", "<header><ul>{}</ul></header>", "<nav>{}</nav>", "<ul class='menu'>{}</ul>"])
        add(form.format(links(n)), *[False] * n)

    def head() -> None:
        add(r.choice([f"<header><h1>{prose(1, 5)}</h1></header>", f"<div{cls('header', 'masthead', 'banner', 'logo', 'topbar')}>{prose(1, 6)}</div>", f"<header{cls('site')}><p>{prose(1, 8)}</p></header>"]), False)

    def advert() -> None:
        add(r.choice([f"<div{cls('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{phrase('advert', 2, 25)}</div>", f"<aside{cls('ad', 'promo')}><p>{phrase('advert', 3, 25)}</p></aside>", f"<ins class='adsbygoogle'><div>{phrase('advert', 2, 9)}</div></ins>"]), False)

    def notice() -> None:
        add(f"<div{cls('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'banner')}>{r.choice(['<p>{}</p>', '{}', '<span>{}</span>']).format(phrase('notice', 4, 30))}</div>", False)

    def aside() -> None:
        if r.random() < 0.5:
            n = r.randint(1, 6)
            add(f"<aside><ul>{links(n)}</ul></aside>", *[False] * n)
        else:
            add(r.choice([f"<aside><p>{phrase('aside', 4, 30)}</p></aside>", f"<div{cls('sidebar', 'side', 'widget', 'related', 'recommended', 'share', 'social')}><p>{phrase('aside', 2, 30)}</p></div>", f"<div{cls('sidebar', 'related', 'widget')}>{phrase('aside', 2, 30)}</div>"]), False)

    def form() -> None:
        add(r.choice([f"<form{cls('search', 'login', 'newsletter', 'subscribe', 'signup')}><label>{phrase('form', 1, 4)}</label><input name=q></form>", f"<form><p>{phrase('form', 1, 8)}</p><input></form>", f"<form><button>{phrase('form', 1, 2)}</button></form>", f"<div{cls('newsletter', 'subscribe', 'signup')}><p>{phrase('form', 2, 12)}</p></div>"]), False)

    def comments() -> None:
        n = r.randint(1, 5)
        one = r.choice([f"<div class='{r.choice(['comment', 'reply'])}'>{{}}</div>", f"<li class='comment'>{{}}</li>", f"<p>{{}}</p>", f"<div class='comment'><p>{{}}</p></div>", "<article class='comment'>{}</article>", "<blockquote>{}</blockquote>"])
        add(f"<{(t := r.choice(['section', 'div', 'ol']))}{cls('comments', 'discussion', 'replies', 'disqus', 'responses')}>" + "".join(one.format(phrase('comment', 2, 60)) for _ in range(n)) + f"</{t}>", *[False] * n)

    def foot() -> None:
        add(r.choice(["<footer>{}</footer>", "<footer><p>{}</p></footer>", f"<div{cls('footer', 'foot', 'copyright', 'legal', 'bottom')}>{{}}</div>"]).format(r.choice(["&copy; ", "", ""]) + phrase('foot', 2, 25)), False)

    def main() -> None:
        opened = r.choice(["article"] * 6 + ["main", "main><article", f"div{cls('content', 'post', 'entry', 'story', 'article', 'body', 'main', 'text')}", f"section{cls('content', 'article', 'post', 'story')}", "main><div class='content'"])
        add(f"<{opened}>")
        inner = r.random()
        if r.random() < 0.8:
            add(f"<h1>{prose(1, 10)}</h1>" if r.random() < 0.85 else f"<header><h1>{prose(1, 10)}</h1></header>", True)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.62:
                add(f"<p>{prose(1, 90)}</p>", True)
            elif kind < 0.74:
                add(f"<p><b>{prose(1, 60)}<br>", True)
                add(f"<p>{prose(1, 60)}</p>", True)
            elif kind < 0.80:
                add(f"<h{(h := r.randint(2, 4))}>{prose(1, 8)}</h{h}>", True)
            elif kind < 0.86:
                n = r.randint(1, 5)
                add("<ul>" + "".join(f"<li>{prose(1, 20)}</li>" for _ in range(n)) + "</ul>", *[True] * n)
            elif kind < 0.90:
                add(f"<{(t := r.choice(['blockquote', 'pre', 'figcaption', 'div', 'section']))}>{prose(2, 50)}</{t}>", True)
            elif kind < 0.93:
                n = r.randint(1, 4)
                add("<table><tr>" + "".join(f"<td>{prose(1, 6)}</td>" for _ in range(n)) + "</tr></table>", *[True] * n)
            elif kind < 0.96 and inner < 0.5:
                r.choice([advert, aside, form, notice])()
            else:
                add(f"<p>{prose(2, 30)} <a href='/{word()}'>{prose(1, 4)}</a> {prose(2, 30)}</p>", True)
        if inner > 0.8:
            comments()
        if "><" in opened:
            add(f"</{'article' if 'article' in opened else 'div'}></main>")
        else:
            add(f"</{opened.split()[0]}>")

    for part in r.sample([head, menu, advert, notice, aside, form], r.randint(0, 5)):
        part()
    main()
    for part in r.sample([comments, advert, aside, form, foot, menu, notice], r.randint(0, 4)):
        part()
    if r.random() < 0.7:
        foot()
    closing = "</body></html>" if r.random() < 0.8 else ""
    return f"<html><head><title>{prose(1, 6)}</title></head><body>" + "".join(out) + closing, truth


@functools.lru_cache(maxsize=1)
def labeller(seed: int = 11, pages: int = TRAIN_PAGES) -> BlockLabeller:
    """Trained once for each driver process."""
    r, made = random.Random(seed), []
    for _ in range(pages):
        page, truth = training_page(r)
        own = blocks(page)
        if len(own) == len(truth):
            made.append((vectors(own), np.array(truth, np.float32)))
    return BlockLabeller().fit(made)


def extract(model: BlockLabeller, pages: list[str | None]) -> list[str]:
    own = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, main in zip(bs, m, strict=True) if main) for bs, m in zip(own, model.label(own), strict=True)]


def main_text(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but ``text``), then ``text``: main blocks in page order, joined by a line feed.

    Null and empty pages, and pages without a main block, give an empty text.  Nothing of a main block is dropped, however long or
    deeply nested a page is.  Rows that repeat give equal texts; an empty table gives no rows.  Ties: a margin of zero is no main text.
    A column ``text`` of ``pages`` is replaced.
    """
    keep = [c for c in pages.columns if c != "text"] if keep is None else keep
    model = labeller()
    return map_rows(pages, lambda own: [extract(model, own)], [html_column], [("text", pa.string(), "string")], keep)


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from pyspark.sql import functions as F

    found = main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
