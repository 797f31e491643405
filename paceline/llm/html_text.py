"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: stretches of text between the starts and ends of
block-level elements. Features are the tags, classes and ids of a block's ancestors, and
its length, links, signs and place. The field has two labels (main text or not) and is
trained, by gradient steps on its likelihood, on the labelled pages that
`labelled_page` writes in many layouts; Viterbi decodes a page.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Fixed values of HTML: block-level elements, elements whose text isn't shown, what a start tag closes.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head iframe math noembed noscript object script style svg template textarea title video audio canvas".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = frozenset("button option optgroup td th li caption summary legend dt dd tr tbody thead tfoot body html select".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

#: Words in classes, ids and roles, by what they say of an element.
HINTS = {
    "advert": "ad ads adbox adsense advert adverts advertisement advertising banner billboard promo promoted promotion sponsor sponsored",
    "menu": "breadcrumb breadcrumbs dropdown menu menubar nav navbar navigation pagination pager tabs toc topbar toolbar",
    "comment": "comment comments commentlist disqus discussion replies reply respond responses",
    "notice": "alert consent cookie cookies dialog disclaimer gdpr modal newsletter notice notification paywall popup privacy signup subscribe",
    "side": "aside complementary recommended related recirculation sidebar side trending widget widgets popular",
    "frame": "bottom contentinfo copyright footer head header legal masthead site-footer site-header top",
    "share": "author bookmark byline facebook like meta share sharing social tags twitter",
    "main": "article articlebody body content entry main maincontent post prose story text",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}


class Block(NamedTuple):
    text: str
    path: frozenset
    linked: int


def _own_features(tag: str, attributes: str) -> frozenset:
    found = {f"in:{tag}"} if tag in BLOCKS else set()
    for m in _NAMES.finditer(attributes):
        for part in _PART.findall((m[2] or m[3] or m[4] or "").lower()):
            if part in _HINT:
                found.add(f"hint:{_HINT[part]}")
    return frozenset(found)


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order; those without text are left out."""
    stack: list[tuple[str, frozenset]] = []
    path: frozenset = frozenset()
    blocks, parts, linked, in_link, hidden, at = [], [], 0, 0, 0, 0
    seen: dict[tuple[str, str], frozenset] = {}

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                leaf = next((t for t, _ in reversed(stack) if t in BLOCKS), "body")
                blocks.append(Block(text, path | {f"leaf:{leaf}"}, linked))
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal path, hidden
        for t, _ in stack[i:]:
            hidden -= t in HIDDEN
        del stack[i:]
        path = stack[-1][1] if stack else frozenset()

    while m := _TOKEN.match(page, at):
        at = m.end()
        if m[7] is not None:
            if not hidden:
                text = html.unescape(m[7]) if "&" in m[7] else m[7]
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                in_link = 0
            if tag in BLOCKS or tag in HIDDEN:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if tag in BLOCKS and not hidden:
                    end_block()
                if i >= 0:
                    pop_to(i)
                    in_link = 0
            continue
        if tag in VOID:
            if tag == "hr" and not hidden:
                end_block()
            elif tag == "br" and not hidden:
                parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if end and close >= 0 else len(page)
            continue
        if tag == "a":
            in_link = 1
            continue
        if attributes.endswith("/") and tag in HIDDEN:
            continue
        if tag in BLOCKS or tag in HIDDEN:
            if tag in BLOCKS and not hidden:
                end_block()
            if tag == "body":  # a head that was never closed ends here
                i = next((i for i, (t, _) in enumerate(stack) if t == "head"), -1)
                if i >= 0:
                    pop_to(i)
            if tag in CLOSES:
                i = len(stack) - 1
                while i >= 0 and stack[i][0] in CLOSES[tag] | {"p"}:
                    i -= 1
                pop_to(i + 1)
            elif tag in BLOCKS and tag not in KEEPS_P and stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            own = seen.get((tag, attributes))
            if own is None:
                own = seen[tag, attributes] = _own_features(tag, attributes)
            path = path | own
            stack.append((tag, path))
            hidden += tag in HIDDEN
            in_link = 0
    end_block()
    return blocks


def block_features(blocks: list[Block], i: int) -> list[str]:
    """Names of the features of block i, besides those of its path."""
    text, _, linked = blocks[i]
    n, words = len(text), text.count(" ") + 1
    out = [f"words:{min(6, words.bit_length())}", f"links:{min(3, 4 * linked // max(1, n))}"]
    if text[-1] in ".!?:\"'…”»":
        out.append("ends")
    if "," in text:
        out.append("comma")
    if "©" in text or "(c)" in text[:40].lower():
        out.append("copyright")
    if i == 0:
        out.append("first")
    if i == len(blocks) - 1:
        out.append("last")
    if text.isupper():
        out.append("capitals")
    return out


# ---- labelled pages

_MAIN, _REST = "\ue000", "\ue001"


def labelled_page(rng: np.random.Generator) -> str:
    """A page whose texts begin with U+E000 where they are main text and U+E001 where not."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("abcdefghilmnoprstuvaeioéüñ") for _ in range(int(rng.integers(1, 10))))

    def prose(low: int, high: int) -> str:
        words = [word() + pick([""] * 7 + [",", ".", "."]) for _ in range(int(rng.integers(low, high)))]
        return " ".join(words).capitalize() + pick([".", ".", ".", "", "!"])

    short = lambda: prose(1, 5).rstrip(".!")
    named = lambda tag, hints: pick([f'<{tag} class="{pick(hints)}">', f'<{tag} id="{pick(hints)}">', f'<{tag} class="{pick(hints)} {word()}">'])

    def links() -> str:
        items = "".join(f'<li><a href="/{word()}">{_REST}{short()}</a></li>' for _ in range(int(rng.integers(2, 9))))
        return pick([f"<ul>{items}</ul>", f"<ul>{items}</ul>", "".join(f'<a href="/{word()}">{_REST}{short()}</a> ' for _ in range(4))])

    def boxed(hints: list[str], inner: str, tags: tuple = ("div", "section")) -> str:
        tag = pick(tags)
        return f"{named(tag, hints)}{inner}</{tag}>"

    texts = lambda n, mark, low=3, high=60: "".join(f"<p>{mark}{prose(low, high)}</p>" if chance(0.8) else f"<p>{mark}{prose(low, high)}" for _ in range(n))
    advert = lambda: boxed(["ad", "ads", "advert", "banner", "promo", "sponsored"], pick([_REST + prose(3, 30), texts(1, _REST, 3, 30)]))
    menu = lambda: pick([f"<nav>{links()}</nav>", boxed(["menu", "nav", "navbar", "breadcrumb"], links())])
    notice = lambda: boxed(["cookie-notice", "consent", "notice", "popup", "newsletter-signup"], texts(1, _REST, 5, 40) + f"<button>{_REST}{short()}</button>")
    side = lambda: pick([f"<aside>{_REST}{prose(5, 40)}{links()}</aside>", boxed(["sidebar", "related", "widget"], f"<h3>{_REST}{short()}</h3>" + pick([links(), texts(2, _REST)]))])
    form = lambda: f"<form action='/{word()}'><label>{_REST}{short()}</label><input name='q'><select><option>{_REST}{short()}<option>{_REST}{short()}</select><button>{_REST}{short()}</button>{pick(['', texts(1, _REST)])}</form>"
    comments = lambda: boxed(["comments", "comment-list", "replies", "disqus"], f"<h3>{_REST}{short()}</h3>" + "".join(boxed(["comment", "reply"], pick([_REST + prose(4, 70), texts(2, _REST, 4, 60)])) for _ in range(int(rng.integers(1, 5)))), ("div", "section", "ol"))
    share = lambda: boxed(["share", "social", "byline", "meta"], f"{_REST}{short()} <a href='#'>{_REST}{short()}</a>")

    def article() -> str:
        inner = [f"<h1>{_MAIN}{prose(2, 14)}</h1>"] if chance(0.9) else []
        if chance(0.5):
            inner.append(f"<p><b>{_MAIN}{prose(2, 90)}<br>")
        for _ in range(int(rng.integers(1, 12))):
            r = rng.random()
            if r < 0.72:
                inner.append(texts(1, _MAIN, *pick([(1, 4), (5, 40), (20, 120), (20, 120)])))
            elif r < 0.78:
                inner.append(f"<h2>{_MAIN}{short()}</h2>")
            elif r < 0.83:
                inner.append("<ul>" + "".join(f"<li>{_MAIN}{prose(1, 25)}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.87:
                inner.append(f"<blockquote>{_MAIN}{prose(5, 40)}</blockquote>")
            elif r < 0.90:
                inner.append(f"<pre>{_MAIN}{prose(3, 20)}</pre>")
            elif r < 0.93:
                inner.append(f"<p>{_MAIN}{prose(3, 20)} <a href='/{word()}'>{short()}</a> {prose(2, 20)}</p>")
            elif r < 0.95:
                inner.append(f"<table><tr><td>{_MAIN}{short()}<td>{_MAIN}{prose(1, 9)}</table>")
            else:
                inner.append(pick([advert, share, side, notice, form])())
        body = "".join(inner)
        if chance(0.15):
            body += pick([share, comments])()
        return pick([f"<article>{body}</article>"] * 5 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", boxed(["content", "post", "entry-content", "article-body", "story", "main"], body), f"<div>{body}</div>", body])

    before = [menu() if chance(0.8) else ""]
    if chance(0.4):
        before.append(pick([f"<header>{_REST}{short()}{pick(['', links()])}</header>", boxed(["header", "masthead", "top"], f"<h1>{_REST}{short()}</h1>")]))
    before += [make() for make, p in ((advert, 0.6), (notice, 0.25), (form, 0.15), (side, 0.15)) if chance(p)]
    after = [make() for make, p in ((share, 0.2), (comments, 0.4), (side, 0.35), (advert, 0.3), (form, 0.15), (notice, 0.15), (menu, 0.15)) if chance(p)]
    foot = pick([f"<footer>&copy; {_REST}{short()} &middot; {prose(2, 25)}</footer>"] * 3 + [boxed(["footer", "copyright", "bottom", "legal"], f"{_REST}&copy; {prose(2, 20)}"), ""])
    return f"<html><head><title>{short()}</title></head><body>{''.join(before)}{article()}{''.join(after)}{foot}</body></html>"


# ---- the field


class Field:
    """Weights of a two-label linear-chain field: names -> (rest, main)."""

    def __init__(self, pages: int = 500, steps: int = 120, seed: int = 9, rate: float = 0.15):
        rng = np.random.default_rng(seed)
        self.names: dict[str, int] = {}
        rows, labels, ends = [], [], []
        for _ in range(pages):
            blocks = [b for b in leaf_blocks(labelled_page(rng)) if _MAIN in b.text or _REST in b.text]
            marks = [_MAIN in b.text for b in blocks]
            blocks = [Block(b.text.replace(_MAIN, "").replace(_REST, "") or "x", b.path, b.linked) for b in blocks]
            rows += [[self.names.setdefault(f, len(self.names)) for f in (*sorted(b.path), *block_features(blocks, i))] for i, b in enumerate(blocks)]
            labels += marks
            ends.append(len(blocks))
        longest = max(ends)
        x = np.zeros((pages, longest, len(self.names)), np.float32)
        y, mask = np.zeros((pages, longest), np.int64), np.zeros((pages, longest), bool)
        at = 0
        for p, n in enumerate(ends):
            for t in range(n):
                x[p, t, rows[at + t]] = 1
                y[p, t] = labels[at + t]
            mask[p, :n] = True
            at += n
        self.w, self.move = np.zeros((len(self.names), 2), np.float32), np.zeros((2, 2), np.float32)
        self._train(x, y, mask, steps, rate)
        self.paths: dict[frozenset, np.ndarray] = {}

    def __getstate__(self):
        return {"names": self.names, "w": self.w, "move": self.move, "paths": {}}

    def _train(self, x, y, mask, steps: int, rate: float) -> None:
        n, length, _ = x.shape
        first, second = [0, 0], [0, 0]
        rows, times = np.arange(n)[:, None], np.arange(length)[None, :]
        both = mask[:, 1:] & mask[:, :-1]
        for step in range(1, steps + 1):
            emit = np.where(mask[:, :, None], x @ self.w, 0)
            e, m = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(self.move)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            scale = np.ones((n, length), np.float32)
            for t in range(length):
                a = e[:, t] if t == 0 else (alpha[:, t - 1] @ m) * e[:, t]
                scale[:, t] = a.sum(axis=1)
                alpha[:, t] = a / scale[:, t, None]
            for t in range(length - 2, -1, -1):
                b = ((beta[:, t + 1] * e[:, t + 1]) @ m.T) / scale[:, t + 1, None]
                beta[:, t] = np.where(mask[:, t + 1, None], b, 1)
            g = alpha * beta
            g /= g.sum(axis=2, keepdims=True)
            g[rows, times, y] -= 1
            g[~mask] = 0
            pair = alpha[:, :-1, :, None] * m * (beta[:, 1:] * e[:, 1:])[:, :, None, :] / scale[:, 1:, None, None]
            pair = pair[both].sum(axis=0)
            np.subtract.at(pair, (y[:, :-1][both], y[:, 1:][both]), 1)
            total = mask.sum()
            for k, (value, grad) in enumerate(((self.w, np.einsum("nlf,nlt->ft", x, g, optimize=True) / total + 1e-4 * self.w), (self.move, pair / total))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                value -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _of_path(self, path: frozenset) -> np.ndarray:
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            ids = [self.names[f] for f in path if f in self.names]
            known = self.paths[path] = self.w[ids].sum(axis=0) if ids else np.zeros(2, np.float32)
        return known

    def label(self, blocks: list[Block]) -> list[bool]:
        """Whether each block is main text, by Viterbi."""
        if not blocks:
            return []
        names, w = self.names, self.w.tolist()
        (rr, rm), (mr, mm) = self.move.tolist()
        back, rest, main = [], 0.0, 0.0
        for i, b in enumerate(blocks):
            er, em = self._of_path(b.path).tolist()
            for f in block_features(blocks, i):
                k = names.get(f)
                if k is not None:
                    er += w[k][0]
                    em += w[k][1]
            if i == 0:
                rest, main = er, em
                continue
            r, m = (rest + rr, main + mr), (rest + rm, main + mm)
            back.append((r[1] > r[0], m[1] > m[0]))
            rest, main = max(r) + er, max(m) + em
        state, out = main > rest, []
        for pair in reversed(back):
            out.append(state)
            state = pair[state]
        return [state, *reversed(out)]


@functools.lru_cache(maxsize=1)
def trained_field() -> Field:
    return Field()


def main_text(page: str | None, field: Field) -> str:
    """The main blocks' texts in page order, one a line."""
    if not page:
        return ""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, main in zip(blocks, field.label(blocks), strict=True) if main)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """A row for each row of `pages`: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, have the empty text. Repeated rows
    give the same text; an empty table gives an empty result; further columns are not
    read.
    """
    field = field or trained_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [main_text(h, field) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    some = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return small_batches(some).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_text(spark, sf_dir):
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
