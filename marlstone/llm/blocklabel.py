"""A recurrent block labeller in numpy: a bidirectional LSTM over the leaf blocks of a page.

A block is read as the bags of its hashed tag-path and word tokens, through learnt vectors, and a few measures. Both
directions see the whole page, so a block is judged in its context. The network is trained here, on generated pages
whose main blocks are known: layouts, element names, wordings and faults are drawn at random from a seed.
"""

from __future__ import annotations

import functools
import html
import random
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .htmlblocks import Block, read_blocks

PATH_SLOTS, WORD_SLOTS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 2048, 1024, 16, 6, 7, 20
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
TRAINING_PAGES, EPOCHS, SEED = 1200, 8, 5
#: Blocks that the network runs over at once, padding included.
PIECE = 4096


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode()) % slots


@functools.lru_cache(1 << 16)
def _path_slots(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[int, ...]:
    tokens = []
    for depth, (tag, names) in enumerate(reversed(path)):
        tokens.append(f"<{tag}")
        tokens += [f".{n}" for n in names]
        if depth < 2:
            tokens.append(f"{depth}<{tag}")
            tokens += [f"{depth}.{n}" for n in names]
    return tuple(_slot(t, PATH_SLOTS) for t in dict.fromkeys(tokens))


def features(blocks: Sequence[Block]) -> tuple[list[tuple[int, ...]], list[list[int]], np.ndarray]:
    """Of every block: path slots, the slots of all its words, and measures."""
    paths = [_path_slots(tuple((e.tag, e.names) for e in b.path if e.tag not in ("html", "body"))) for b in blocks]
    words, measures = [], np.zeros((len(blocks), MEASURES))
    for i, b in enumerate(blocks):
        split = b.text.lower().encode("utf-8", "replace").split()
        words.append([zlib.crc32(w) % WORD_SLOTS for w in split])
        n = len(b.text)
        measures[i] = (np.log1p(n) / 6, b.linked / max(n, 1), i / max(len(blocks), 1), b.text[-1:] in ".!?:", len(split) <= 3, "©" in b.text, b.path[-1].tag[:1] == "h" if b.path else 0)
    return paths, words, measures


def _bag(slots: Sequence[Sequence[int]], table: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sum of each bag's vectors over its size to the power; and what the gradient needs."""
    sizes = np.array([len(s) for s in slots])
    flat = np.fromiter((x for s in slots for x in s), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(slots)), sizes)
    scale = 1.0 / np.maximum(sizes, 1) ** power
    out = np.stack([np.bincount(owner, column[flat], len(slots)) for column in table.T], axis=1)
    return out * scale[:, None], flat, owner, scale


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
    """An LSTM over x (time, batch, input) from a state; states stand still where the mask is 0."""
    steps, batch, hidden = x.shape[0], x.shape[1], u.shape[0]
    h, c = state or (np.zeros((batch, hidden)), np.zeros((batch, hidden)))
    out, trace = np.zeros((steps, batch, hidden)), []
    inputs = x @ w + b
    for t in range(steps):
        z = inputs[t] + h @ u
        i, f, o = _sigmoid(z[:, :hidden]), _sigmoid(z[:, hidden : 2 * hidden] + 1), _sigmoid(z[:, 2 * hidden : 3 * hidden])
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        fresh = f * c + i * g
        tanh = np.tanh(fresh)
        if keep:
            trace.append((h, c, i, f, o, g, tanh, m))
        c = m * fresh + (1 - m) * c
        h = m * (o * tanh) + (1 - m) * h
        out[t] = h
    return out, trace, (h, c)


def _run_back(d_out: np.ndarray, x: np.ndarray, trace: list, w: np.ndarray, u: np.ndarray):
    steps, batch, hidden = d_out.shape
    dh, dc = np.zeros((batch, hidden)), np.zeros((batch, hidden))
    du, dz = np.zeros_like(u), np.zeros((steps, batch, 4 * hidden))
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tanh, m = trace[t]
        dh = dh + d_out[t]
        now = dh * m
        d_fresh = now * o * (1 - tanh**2) + dc * m
        dz[t, :, :hidden] = d_fresh * g * i * (1 - i)
        dz[t, :, hidden : 2 * hidden] = d_fresh * c * f * (1 - f)
        dz[t, :, 2 * hidden : 3 * hidden] = now * tanh * o * (1 - o)
        dz[t, :, 3 * hidden :] = d_fresh * i * (1 - g**2)
        du += h.T @ dz[t]
        dh = dz[t] @ u.T + dh * (1 - m)
        dc = d_fresh * f + dc * (1 - m)
    flat = dz.reshape(-1, 4 * hidden)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


@dataclass
class Labeller:
    parts: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3 / np.sqrt(shape[0]), shape)
        parts = {"paths": rng.normal(0, 0.1, (PATH_SLOTS, PATH_SIZE)), "words": rng.normal(0, 0.1, (WORD_SLOTS, WORD_SIZE))}
        for side in "fb":
            parts |= {f"w{side}": draw(INPUT, 4 * HIDDEN) * 3, f"u{side}": draw(HIDDEN, 4 * HIDDEN) * 3, f"b{side}": np.zeros(4 * HIDDEN)}
        return cls(parts | {"v": draw(2 * HIDDEN + INPUT), "c": np.zeros(1)})

    def _rows(self, pages: list):
        """The inputs of all blocks of some pages, and what the gradient needs."""
        p = self.parts
        bags = [_bag([s for f in pages for s in f[0]], p["paths"], 0.5), _bag([s for f in pages for s in f[1]], p["words"], 1.0)]
        return np.concatenate([bags[0][0], bags[1][0], np.concatenate([f[2] for f in pages])], axis=1), bags

    def _forward(self, pages: list, keep: bool):
        p = self.parts
        sizes = [len(f[0]) for f in pages]
        steps = max(sizes)
        rows, bags = self._rows(pages)
        time = np.concatenate([np.arange(n) for n in sizes])
        page = np.repeat(np.arange(len(pages)), sizes)
        x, mask = np.zeros((steps, len(pages), INPUT)), np.zeros((steps, len(pages)))
        x[time, page], mask[time, page] = rows, 1
        forth, trace_f, _ = _run(x, mask, p["wf"], p["uf"], p["bf"], keep)
        back, trace_b, _ = _run(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"], keep)
        joint = np.concatenate([forth, back[::-1], x], axis=2)
        logits = joint[time, page] @ p["v"] + p["c"]
        return logits, (x, joint, time, page, trace_f, trace_b, bags)

    def _long(self, page: tuple) -> np.ndarray:
        """The logits of one long page: both directions run over it in pieces and hand their states on."""
        p, n = self.parts, len(page[0])
        spans = [slice(lo, min(lo + PIECE, n)) for lo in range(0, n, PIECE)]
        read = lambda s: self._rows([(page[0][s], page[1][s], page[2][s])])[0][:, None, :]
        out, state = np.empty(n), None
        for s in spans:
            x = read(s)
            forth, _, state = _run(x, np.ones((len(x), 1)), p["wf"], p["uf"], p["bf"], False, state)
            out[s] = forth[:, 0] @ p["v"][:HIDDEN] + x[:, 0] @ p["v"][2 * HIDDEN :] + p["c"]
        state = None
        for s in reversed(spans):
            x = read(s)[::-1]
            back, _, state = _run(x, np.ones((len(x), 1)), p["wb"], p["ub"], p["bb"], False, state)
            out[s] += back[::-1, 0] @ p["v"][HIDDEN : 2 * HIDDEN]
        return out

    def logits(self, pages: list, batch: int = 64) -> list[np.ndarray]:
        """For each page's features, a logit for every block: above 0 is main text. Pages of like length run together,
        as many as have PIECE blocks with the padding; a page with more runs by itself, in pieces."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        groups: list[list[int]] = []
        for i in order:
            size = len(pages[i][0])
            if size > PIECE:
                out[i] = self._long(pages[i])
            elif groups and len(groups[-1]) < batch and (len(groups[-1]) + 1) * size <= PIECE:
                groups[-1].append(i)
            else:
                groups.append([i])
        for some in groups:
            found, _ = self._forward([pages[i] for i in some], False)
            for i, part in zip(some, np.split(found, np.cumsum([len(pages[i][0]) for i in some])[:-1]), strict=True):
                out[i] = part
        return out

    def gradients(self, pages: list, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all blocks."""
        p = self.parts
        logits, (x, joint, time, page, trace_f, trace_b, bags) = self._forward(pages, True)
        d_logit = (_sigmoid(logits) - labels) / len(labels)
        d_joint = np.zeros_like(joint)
        d_joint[time, page] = d_logit[:, None] * p["v"]
        out = {"v": joint[time, page].T @ d_logit, "c": d_logit.sum(keepdims=True)}
        dx_f, out["wf"], out["uf"], out["bf"] = _run_back(d_joint[:, :, :HIDDEN], x, trace_f, p["wf"], p["uf"])
        dx_b, out["wb"], out["ub"], out["bb"] = _run_back(d_joint[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], trace_b, p["wb"], p["ub"])
        d_rows = (dx_f + dx_b[::-1] + d_joint[:, :, 2 * HIDDEN :])[time, page]
        for name, (_, flat, owner, scale), lo, hi in (("paths", bags[0], 0, PATH_SIZE), ("words", bags[1], PATH_SIZE, PATH_SIZE + WORD_SIZE)):
            out[name] = np.stack([np.bincount(flat, column[owner], len(p[name])) for column in (d_rows[:, lo:hi] * scale[:, None]).T], axis=1)
        return out

    def train(self, pages: list, labels: list[np.ndarray], epochs: int, batch: int = 24, rate: float = 0.01) -> None:
        """Adam over batches of pages of like length, in a seeded order."""
        rng = np.random.default_rng(SEED)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.parts.items()}
        order, step = sorted(range(len(pages)), key=lambda i: len(pages[i][0])), 0
        groups = [order[lo : lo + batch] for lo in range(0, len(order), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                some, step = groups[g], step + 1
                found = self.gradients([pages[i] for i in some], np.concatenate([labels[i] for i in some]))
                for k, d in found.items():
                    m, s = moments[k]
                    m += 0.1 * (d - m)
                    s += 0.001 * (d * d - s)
                    self.parts[k] -= rate / (1 + 0.5 * epoch) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


# Generated pages ------------------------------------------------------------------------------------------------------

#: Names that sites give to the parts of a page, and wordings of parts that aren't main text.
NAMES = {
    "menu": "menu nav navbar navigation topnav breadcrumbs breadcrumb tabs pager pagination toc skip site-nav main-menu".split(),
    "header": "header masthead top topbar site-header page-header banner logo branding".split(),
    "footer": "footer bottom copyright colophon site-footer page-footer legal".split(),
    "side": "sidebar side aside widget related rail secondary recommended popular trending more-stories".split(),
    "notice": "cookie cookies notice alert consent gdpr warning message popup modal overlay cookie-banner".split(),
    "advert": "ad ads advert advertisement sponsored promo banner-ad adslot sponsor ad-container".split(),
    "form": "newsletter subscribe signup login search searchbox contact-form feedback".split(),
    "comments": "comments comment discussion respond reply disqus reader-comments comment-list replies".split(),
    "share": "share social sharing share-buttons follow".split(),
    "main": "content article post entry story main body article-body post-content entry-content text story-body".split(),
}
WORDINGS = {
    "menu": "Home About Contact News Sports World Politics Business Products Services Blog Archive Help Search Next Previous".split(),
    "header": ["Daily news", "Welcome", "The site of record", "Your trusted source", "Sign in"],
    "footer": ["© 2024 Example", "All rights reserved.", "Privacy policy", "Terms of use", "Contact us", "Powered by"],
    "side": ["Related articles", "Most read", "Popular now", "You may also like", "Tags", "Recent posts"],
    "notice": ["We use cookies.", "This site uses cookies to improve your experience.", "Accept all", "Please enable JavaScript.", "Got it"],
    "advert": ["Advertisement", "Sponsored", "Buy now!", "Special offer today only", "Click here"],
    "form": ["Subscribe to our newsletter", "Your e-mail", "Sign up", "Search", "Log in", "Send"],
    "comments": ["Comments", "3 comments", "Reply", "Leave a comment", "Great article, thanks!", "I disagree.", "Report"],
    "share": ["Share", "Tweet", "Share this", "Print", "E-mail"],
}
_TAGS = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "notice": ["div", "section", "aside", "p"], "advert": ["div", "aside", "section", "p"], "form": ["form"], "comments": ["section", "div", "ol", "div"], "share": ["div", "ul"], "main": ["article", "article", "main", "div", "section"]}


class _Page:
    """A page under construction: markup, and the lines of main text in order."""

    def __init__(self, rng: random.Random):
        self.rng, self.markup, self.lines = rng, [], []
        self.sounds = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouéäö") + rng.choice(["", "", "n", "r", "s"])) for _ in range(30)]

    def word(self) -> str:
        return "".join(self.rng.choice(self.sounds) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, most: int = 16) -> str:
        line = " ".join(self.word() for _ in range(self.rng.randint(1, most))).capitalize()
        return line + self.rng.choice([".", ".", ".", "!", "?", " ***", "%%%", ""])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 3, 6])))

    def names(self, part: str) -> str:
        if self.rng.random() < 0.15 and _TAGS[part][0] != "div":
            return ""
        name = self.rng.choice(NAMES[part]) + self.rng.choice(["", "", "", "-1", " col-md-8", " clearfix"])
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def inner(self, text: str, main: bool) -> str:
        rng, out = self.rng, html.escape(text, quote=False)
        if main and rng.random() < 0.15:
            words = out.split(" ")
            k = rng.randrange(len(words))
            words[k] = rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(words[k])
            out = " ".join(words)
        return out

    def other(self, part: str) -> None:
        """A part that isn't main text, of any wording."""
        rng = self.rng
        tag = rng.choice(_TAGS[part])
        names = self.names(part)
        if tag in ("div", "p", "section", "ul", "ol") and not names:
            names = f' class="{rng.choice(NAMES[part])}"'
        out = [f"<{tag}{names}>"]
        say = lambda: self.inner(rng.choice(WORDINGS[part]) if rng.random() < 0.4 else self.sentence(6) if part in ("menu", "share") else self.prose(), False)
        if part in ("menu", "share") or tag in ("ul", "ol"):
            items = "".join(f'<li><a href="/{k}">{say()}</a></li>' for k in range(rng.randint(1, 8)))
            out.append(items if tag in ("ul", "ol") else f"<ul>{items}</ul>" if rng.random() < 0.8 else " ".join(f'<a href="/{k}">{say()}</a>' for k in range(4)))
        elif part == "form":
            out.append(f"<label>{say()}</label><input name=q><button>{rng.choice(WORDINGS['form'])}</button>")
        elif part == "comments":
            for _ in range(rng.randint(1, 4)):
                out.append(rng.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', "<p>{}</p><p>{}</p>", "<div><span>{}</span><p>{}</p></div>"]).format(self.word(), say()))
        elif tag == "p" or rng.random() < 0.4:
            out.append(say())
        else:
            for _ in range(rng.randint(1, 3)):
                out.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", '<a href="/y">{}</a>']).format(say()))
        self.markup.append("".join(out) + f"</{tag}>")

    def line(self, form: str) -> None:
        text = self.prose() if form in ("p", "blockquote", "div") else self.sentence()
        self.lines.append(" ".join(text.split()))
        body = self.inner(text, True)
        loose = self.rng.random() < 0.15 and form == "p"
        self.markup.append(f"<{form}>{'<b>' if loose else ''}{body}{'<br>' if loose else f'</{form}>'}")

    def main(self) -> None:
        rng = self.rng
        tag = rng.choice(_TAGS["main"])
        plain = tag in ("article", "main")
        names = "" if plain and rng.random() < 0.6 else f' class="{rng.choice(NAMES["main"])}"'
        wrap = rng.random() < 0.3
        self.markup.append(f"<{tag}{names}>" + ('<div class="inner">' if wrap else ""))
        if rng.random() < 0.85:
            self.line(rng.choice(["h1", "h1", "h2"]))
        for _ in range(rng.choice([1, 2, 4, 8, 14, 20])):
            kind = rng.random()
            if kind < 0.82:
                self.line("p")
            elif kind < 0.88:
                self.line(rng.choice(["h2", "h3", "blockquote"]))
            elif kind < 0.93:
                self.markup.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.line("li")
                self.markup.append("</ul>")
            else:
                self.other(rng.choice(["advert", "advert", "side", "form", "share", "notice"]))
        if rng.random() < 0.15:
            self.other("comments")
        self.markup.append(("</div>" if wrap else "") + f"</{tag}>")


def generated_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the lines of its main text."""
    page = _Page(rng)
    page.markup.append(f"<!DOCTYPE html><html><head><title>{page.sentence()}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>")
    wrap = rng.random() < 0.4
    whole = rng.random() < 0.1  # some servers wrap the whole page in a form
    page.markup.append(rng.choice(['<form id="aspnetForm" method="post">', "<form>", '<form class="page">']) if whole else "")
    page.markup.append('<div class="page wrapper">' if wrap else "")
    for part, chance in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("advert", 0.5), ("form", 0.2), ("side", 0.2)):
        if rng.random() < chance:
            page.other(part)
    if rng.random() < 0.97:
        page.main()
    for part, chance in (("share", 0.2), ("side", 0.35), ("advert", 0.25), ("comments", 0.4), ("form", 0.25), ("menu", 0.15), ("footer", 0.85), ("notice", 0.15)):
        if rng.random() < chance:
            page.other(part)
    page.markup.append("</div>" if wrap else "")
    page.markup.append("</form>" if whole else "")
    page.markup.append("</body></html>" if rng.random() < 0.85 else "")
    return "".join(page.markup), page.lines


def labels_of(blocks: Sequence[Block], lines: Sequence[str]) -> np.ndarray:
    """1 for the blocks that are the given lines, in order."""
    out, k = np.zeros(len(blocks)), 0
    for i, b in enumerate(blocks):
        if k < len(lines) and b.text == lines[k]:
            out[i], k = 1, k + 1
    return out


@functools.cache
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, trained once in a process; the same for the same parameters."""
    rng = random.Random(seed)
    inputs, labels = [], []
    for _ in range(pages):
        markup, lines = generated_page(rng)
        blocks = read_blocks(markup)
        if blocks:
            inputs.append(features(blocks))
            labels.append(labels_of(blocks, lines))
    out = Labeller.fresh(seed)
    out.train(inputs, labels, epochs)
    return out
