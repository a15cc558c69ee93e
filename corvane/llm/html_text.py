"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks. Each block is a vector: hashed
tags, classes, ids and roles of the elements around it, hashed words, and a few
measures (length, share of link text, position). A bidirectional LSTM in numpy
reads the whole sequence and labels every block as article or not, so a block's
label can depend on the whole page. It is trained here, on layouts that
``sample_page`` deals out with known labels; nothing is read from the pages.

Scripts, styles, comments and the head never become blocks. Character
references are decoded; white space inside a block becomes one space. A page of
many blocks is read in parts: the states of one direction are kept, not the
vectors, so memory grows by 80 bytes a block beside the texts.

Defined results: null and empty pages have an empty text; pages without markup
are one block; a tag without an end reaches to the end of the page; rows keep
null ids and repeated rows; columns beyond page_id, url and html are not read;
nothing is cut off, however long the page.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import slices, tidied

#: Elements whose content is no text.
_RAW = "script|style|noscript|template|svg|iframe|title"
#: Comments, self-closed and other raw elements, tags (a quote counts behind = only), declarations.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:{_RAW})(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"']))?/>(?:\s*</(?:{_RAW})\s*>)?"
    rf"|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: Elements without content, and elements inside a block of text.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that leave a head open: its end tag may be missing.
_HEAD = set("html base basefont bgsound link meta title style script noscript noframes template".split())
#: Start tags that end an open element of the same kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = set("ul ol dl table select article section div nav aside main body".split())

PATH, WORDS, MEASURES, HIDDEN = 160, 32, 8, 20
INPUT = PATH + WORDS + MEASURES


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tokens of the elements around, text, share of link text) of each block of text, in order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    # How often each name and each token is open: a deep stack is not read again for each tag.
    names: dict[str, int] = {}
    tokens_open: dict[str, int] = {}
    parts: list[str] = []
    linked = anchors = 0
    skip_head = False
    path: tuple[str, ...] = ()

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((path, text, min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def pop(at: int):
        for name, tokens in stack[at:]:
            names[name] -= 1
            for t in tokens:
                tokens_open[t] -= 1
                if not tokens_open[t]:
                    del tokens_open[t]
        del stack[at:]

    at = 0
    for m in _TOKEN.finditer(page):
        raw = page[at : m.start()]
        if skip_head and raw.strip():
            skip_head = False
        if raw and not skip_head:
            parts.append(raw)
            if anchors:
                linked += len(raw.strip())
        at = m.end()
        name = m[3]
        if name is None:
            if not m[0].startswith(("<!", "<?")):
                parts.append(" ")
            continue
        name = name.lower()
        if name == "head":
            skip_head = not m[2]
            continue
        if name == "body" or not m[2] and name not in _HEAD:
            skip_head = False
        if name in _INLINE:
            if name == "a":
                anchors = max(0, anchors + (-1 if m[2] else 1))
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        if m[2]:
            if names.get(name):
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            anchors = 0
        else:
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if any(names.get(k) for k in _ENDS.get(name, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _ENDS[name]:
                        pop(i)
                        break
                    if stack[i][0] in _BOUNDS:
                        break
            if name not in _VOID:
                tokens = [f"tag:{name}"]
                if m[4]:
                    for k, a, b, c in _ATTRIBUTE.findall(m[4]):
                        tokens += [f"{'role' if k.lower() == 'role' else 'name'}:{t}" for t in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()) if t]
                stack.append((name, tuple(tokens)))
                names[name] = names.get(name, 0) + 1
                for t in tokens:
                    tokens_open[t] = tokens_open.get(t, 0) + 1
        path = (*tokens_open, f"leaf:{stack[-1][0]}" if stack else "leaf:")
    if page[at:].strip():
        parts.append(page[at:])
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}
_words: dict[str, int] = {}


def _hash(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        v = np.zeros(PATH, dtype=np.float32)
        for t in set(path):
            h = zlib.crc32(t.encode())
            for k in (h % PATH, (h >> 12) % PATH):
                v[k] += 1.0 if h >> 31 else -1.0
        _paths[path] = v
    return _paths[path]


def vectors(page: list[tuple[tuple[str, ...], str, float]], start: int = 0, total: int | None = None) -> np.ndarray:
    """The vectors of a page's blocks, or of a part of it that begins at start."""
    x, total = np.zeros((len(page), INPUT), dtype=np.float32), total or len(page)
    for i, (path, text, linked) in enumerate(page):
        x[i, :PATH] = _path_vector(path)
        words = text.split(" ")
        for w in words:
            x[i, PATH + _hash(w.lower(), WORDS)] += 1 / len(words)
        n = len(text)
        x[i, PATH + WORDS :] = (np.log1p(n) / 6, linked, text[-1] in ".!?", text[:1].isupper(), (start + i) / total, np.log1p(total) / 5, sum(map(str.isdigit, text)) / n, text.count(",") / (1 + n / 50))
    return x


class Labeller:
    """A bidirectional LSTM over block vectors and a logistic output; p holds its arrays."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = (r.standard_normal((INPUT, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p[f"h{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"b{d}"] = bias
        self.p["o"] = (r.standard_normal((2 * HIDDEN + INPUT, 1)) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list | None = None, state=None) -> tuple[np.ndarray, tuple]:
        """States of one direction (x already in its order) after the given one, and the last; kept gets what the backward pass needs."""
        n, steps, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        pre, out = x @ self.p[f"x{d}"] + self.p[f"b{d}"], np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps):
            z = pre[:, t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if kept is not None:
                kept.append((h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[:, t] = h
        return out, (h, c)

    def _turned(self, x: np.ndarray) -> np.ndarray:
        return x[:, ::-1]

    def _probability(self, every: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(every @ self.p["o"] + self.p["c"], -30, 30)))[..., 0]

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        f, _ = self._run(x, mask, "f", kept and kept[0])
        b, _ = self._run(self._turned(x), self._turned(mask), "b", kept and kept[1])
        every = np.concatenate([f, self._turned(b), x], axis=2)
        return self._probability(every), every

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kf, kb = [], []
        prob, every = self.forward(x, mask, (kf, kb))
        e = ((prob - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        grad = {"o": np.einsum("ntk,nto->ko", every, e), "c": e.sum(axis=(0, 1))}
        back = e @ self.p["o"].T
        for d, kept, xs, dh_all in (("f", kf, x, back[:, :, :HIDDEN]), ("b", kb, self._turned(x), self._turned(back[:, :, HIDDEN : 2 * HIDDEN]))):
            n, steps, _ = x.shape
            dz_all = np.zeros((n, steps, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            for t in range(steps - 1, -1, -1):
                h, c, i, f, o, g, tc, m = kept[t]
                dh = dh + dh_all[:, t]
                do = dh * tc * m
                dct = (dc + dh * o * (1 - tc**2)) * m
                dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g**2)], axis=1)
                dz_all[:, t] = dz
                gh += h.T @ dz
                dh = dz @ self.p[f"h{d}"].T + dh * (1 - m)
                dc = dct * f + dc * (1 - m)
            grad[f"x{d}"] = np.einsum("ntk,ntz->kz", xs, dz_all, optimize=True)
            grad[f"h{d}"] = gh
            grad[f"b{d}"] = dz_all.sum(axis=(0, 1))
        return grad

    def label(self, pages: list[list], most: int = 16_384) -> list[np.ndarray]:
        """Whether each block of each page (of blocks) is article text; pages of similar length run together."""
        out: list = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= most:
                end += 1
            some = order[at:end]
            if len(pages[some[0]]) > most:
                out[some[0]] = self._label_long(pages[some[0]], most)
            else:
                x, mask, _ = padded([vectors(pages[i]) for i in some], None)
                for i, p in zip(some, self.forward(x, mask)[0], strict=True):
                    out[i] = p[: len(pages[i])] >= 0.5
            at = end
        return out

    def _label_long(self, page: list, most: int) -> np.ndarray:
        """The labels of one long page, read in parts: backward first, of which the states are kept, then forward."""
        n, cuts = len(page), range(0, len(page), most)
        part = lambda a: vectors(page[a : a + most], a, n)[None]
        back, out, state = np.zeros((n, HIDDEN), np.float32), np.zeros(n, dtype=bool), None
        for a in reversed(cuts):
            x = part(a)
            states, state = self._run(self._turned(x), np.ones(x.shape[:2], dtype=bool), "b", state=state)
            back[a : a + most] = self._turned(states)[0]
        state = None
        for a in cuts:
            x = part(a)
            states, state = self._run(x, np.ones(x.shape[:2], dtype=bool), "f", state=state)
            out[a : a + most] = self._probability(np.concatenate([states[0], back[a : a + most], x[0]], axis=1)) >= 0.5
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask, y = np.zeros((len(pages), steps, INPUT), np.float32), np.zeros((len(pages), steps), bool), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
        if labels is not None:
            y[i, : len(p)] = labels[i]
    return x, mask, y


def _prose(r, low: int, high: int) -> str:
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve che que ion ung sch keit ez os la el eau ment".split()
    out = []
    for _ in range(int(r.integers(low, high + 1))):
        out.append("".join(r.choice(syllables, int(r.integers(1, 5)))))
    out[0] = out[0].capitalize()
    return " ".join(out)


#: Names that layouts use for what is not the article, and phrases found there.
_ASIDE = "ad ads advert advertisement adbox banner promo sponsor sponsored cookie consent notice alert sidebar widget related recommended share social menu navbar navigation breadcrumb breadcrumbs comments comment reply respond discussion newsletter subscribe signup footer header masthead topbar login search popup modal overlay pagination pager tags toolbar meta legal copyright disclaimer paywall teaser trending popular".split()
_MAIN = "article content main post entry story body text articlebody postbody page single".split()
_PHRASES = ["Copyright 2024", "All rights reserved", "Subscribe to our newsletter", "We use cookies", "Accept", "Leave a reply", "Log in", "Sign up", "Share this", "Related articles", "Advertisement", "Read more", "Home", "Contact", "Privacy policy", "Next", "Search", "© example.com ·"]


_TITLES = ["Comments", "3 Comments", "Leave a comment", "Discussion", "Related", "Related posts", "You may also like", "Newsletter", "More from us", "Popular now"]


def sample_page(r) -> str:
    """A page of a random layout; blocks of the article carry the name ``yes`` at the end, for ``labelled_page``."""
    pick = lambda x: x[int(r.integers(len(x)))]
    some = lambda low, high: range(int(r.integers(low, high + 1)))

    def line(low=1, high=12):
        return pick(_PHRASES) + " " + _prose(r, 1, 4) if r.random() < 0.3 else _prose(r, low, high) + pick(["", ".", "."])

    def links():
        return "<ul>" + "".join(f'<li><a href="/x">{_prose(r, 1, 3)}</a>' + pick(["</li>", ""]) for _ in some(2, 8)) + "</ul>"

    def prose_tag(yes):
        mark = "\x01" if yes else ""
        return f"<p>{mark}{_prose(r, 3, 60)}{pick(['.', '.', ''])}" + pick(["</p>", "</p>", ""])

    def headed():
        tag = pick(["h2", "h3", "h4", "strong"])
        title = pick(_TITLES) if r.random() < 0.6 else line(1, 5)
        return f"<{tag}>{title}</{tag}>" + "".join(prose_tag(False) for _ in range(int(r.integers(1, 4))))

    def boiler():
        name = pick(_ASIDE) + pick(["", "", "-box", "_wrap", " widget", "-1"])
        kind = pick(["nav", "aside", "footer", "header", "form", "named", "named", "named", "named"])
        if kind == "nav":
            inner = links()
        elif kind == "form":
            inner = f"<label>{line(1, 3)}</label><input><select><option>{_prose(r, 1, 2)}<option>{_prose(r, 1, 2)}</select><textarea>{line(1, 5)}</textarea><button>{line(1, 2)}</button>"
        else:
            inner = pick([links, lambda: line(2, 40), headed, headed, lambda: prose_tag(False) + prose_tag(False), lambda: prose_tag(False), lambda: f"<div>{line(3, 20)}</div>"])()
        if kind == "named":
            tag, key = pick(["div", "section", "div", "ul", "p", "span", "div"]), pick(["class", "class", "id"])
            tag = "div" if tag in ("span", "ul", "p") and "<" in inner else tag
            tag = "div" if tag == "span" else tag
            return f'<{tag} {key}="{name}">{inner}</{tag}>'
        return f"<{kind}>{inner}</{kind}>"

    def readers():
        tag, name = pick(["section", "section", "div"]), pick(["comments", "comments", "comment-list", "discussion", "responses", "reply comments"])
        said = "".join(f"<p>{_prose(r, 1, 25)}{pick(['.', '!', ''])}</p>" if r.random() < 0.7 else f"<div>{_prose(r, 1, 12)}.</div>" for _ in range(int(r.integers(1, 5))))
        return f'<{tag} {pick(["class", "class", "id"])}="{name}"><{pick(["h2", "h3", "h2"])}>{pick(_TITLES[:4])}</h2>{said}</{tag}>'

    def main_block():
        rows = lambda: f"<table><tr><td>\x01{_prose(r, 1, 6)}<td>\x01{_prose(r, 1, 6)}</table>"
        return pick(
            [lambda: prose_tag(True)] * 8
            + [
                lambda: f"<h2>\x01{_prose(r, 1, 9)}</h2>",
                lambda: "<ul>" + "".join(f"<li>\x01{_prose(r, 2, 20)}</li>" for _ in some(1, 5)) + "</ul>",
                lambda: f"<blockquote>\x01{_prose(r, 4, 40)}.</blockquote>",
                lambda: f"<pre>\x01{_prose(r, 2, 20)}</pre>",
                rows,
                lambda: "<dl>" + "".join(f"<dt>\x01{_prose(r, 1, 4)}{pick(['</dt>', ''])}<dd>\x01{_prose(r, 2, 20)}.{pick(['</dd>', ''])}" for _ in range(int(r.integers(1, 4)))) + "</dl>",
                lambda: f"<figure><figcaption>\x01{_prose(r, 2, 12)}.</figcaption></figure>",
                lambda: f"<div>\x01{_prose(r, 6, 50)}.</div>",
                lambda: f'<p><a href="/y">\x01{_prose(r, 2, 9)}</a> {_prose(r, 2, 9)}.</p>',
            ]
        )()

    wrap = r.random()
    framed = wrap >= 0.15
    body = [f"<h1>\x01{_prose(r, 2, 14)}</h1>"] if r.random() < (0.9 if framed else 0.5) else []
    if body and r.random() < 0.25:
        body = [f"<header>{body[0]}</header>"]
    for _ in some(1, 14):
        body.append(boiler() if r.random() < 0.08 else main_block())
    inner = "".join(body)
    if not framed:
        pass  # blocks of the body itself
    elif wrap < 0.55:
        inner = f"<article>{inner}" + (boiler() if r.random() < 0.1 else "") + "</article>"
    elif wrap < 0.7:
        inner = f"<main>{inner}</main>"
    else:
        inner = f'<div {pick(["class", "id"])}="{pick(_MAIN)}{pick(["", "-content", " clearfix"])}">{inner}</div>'
    if r.random() < 0.25:
        inner += readers()
    if framed and r.random() < 0.3:
        inner = f'<div class="{pick(["wrapper", "container", "row", "page"])}">{boiler() if r.random() < 0.4 else ""}{inner}{boiler() if r.random() < 0.4 else ""}</div>'
    if not framed and r.random() < 0.5:
        return pick(["<html><head><title>x</title></head><body>", ""]) + inner
    return "<html><head><title>x</title></head><body>" + "".join(boiler() for _ in some(0, 4)) + inner + "".join(boiler() for _ in some(0, 4)) + pick(["</body></html>", ""])


def labelled_page(page: str) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(page)
    y = np.array([t.startswith("\x01") for _, t, _ in found])
    return vectors([(p, t.replace("\x01", "").strip() or "x", k) for p, t, k in found]), y


_trained: list[Labeller] = []


def train(pages: int = 2400, epochs: int = 6, seed: int = 9) -> Labeller:
    """Trained with Adam on dealt layouts; once for each driver process."""
    if _trained:
        return _trained[0]
    r = np.random.default_rng(seed)
    data = [d for d in (labelled_page(sample_page(r)) for _ in range(pages)) if len(d[0])]
    data.sort(key=lambda d: len(d[0]))
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    model = Labeller()
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step = 0
    for epoch in range(epochs):
        for b in r.permutation(len(batches)):
            x, mask, y = padded([d[0] for d in batches[b]], [d[1] for d in batches[b]])
            grad = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * 0.6**epoch
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    _trained.append(model)
    return model


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p or "") for p in pages]
    labels = model.label(found)
    return ["\n\n".join(t for (_, t, _), keep in zip(b, y.tolist(), strict=True) if keep) for b, y in zip(found, labels, strict=True)]


def main_texts(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html", 4 << 20, 256):
                texts = extract(some.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
