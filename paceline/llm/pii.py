"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy, from labelled spans that `labelled_text` writes: made-up
prose with addresses, numbers and look-alikes in many layouts. Its weights are kept beside
this module, so that a session doesn't train first. Texts are read in windows of WINDOW
characters, half of which overlap the next. Each window is decoded by Viterbi; a span counts
in the window whose core it starts in, and what goes on past that window's end in the next
one as well; spans of a kind that touch or overlap are joined over the whole text. Every
span that passes its check holds a digit, an @, (at) or [at] in any case: decoded are the windows that
hold one of these and, from there on, all that a span found reaches or touches. Other
windows have no part in any span that passes.

The patterns' spans always stay. The network adds spans that overlap none of them and
pass the exact check of their kind.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
HIDDEN, EMBED, STEPS, BATCH = 16, 10, 260, 48
#: Tags: none, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)

_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: what follows the run is the same from any of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# ---- exact checks and patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _fits(kind: str, text: str) -> bool:
    digits = digits_of(text)
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in text.split(".")))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """What the e-mail pattern finds from left to right, looked for around each @."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; ends are exclusive."""
    spans = [("email", a, z) for a, z in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            spans += [(kind, *m.span()) for m in pattern.finditer(text) if _fits(kind, m[0])]
    return spans


#: Fixed words: names of numbers that are laid out like telephone numbers but aren't any.
OTHER_NUMBERS = ("isbn", "issn", "ean", "ssn", "vat", "iban", "order", "invoice", "ticket", "case", "ref", "reference", "serial", "part", "model", "account", "tracking", "id", "lot", "batch", "version", "doi", "patent")
_NAMED = re.compile(rf"(?<![a-z])(?:{'|'.join(OTHER_NUMBERS)})(?:[ -]?1[03])?(?:\s(?:no|nr|number|code)\b)?[\s.:#=-]*$", re.IGNORECASE)
_EMAIL_LIKE = re.compile(r"[\w.%+-]+\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)+", re.IGNORECASE)
_IP_LIKE = re.compile(r"[0-9]{1,3}(?:\s?(?:\.|\[\.\])\s?[0-9]{1,3}){3}")
_CARD_LIKE, _PHONE_LIKE = re.compile(r"[0-9][0-9 ./-]+[0-9]"), re.compile(r"\+?\(?[0-9][0-9 ()./-]+[0-9]")
_GROUPS = re.compile(r"[0-9)][ ./-]+\(?[0-9]")
#: Layouts of dates, United States social security numbers and ISBNs.
_OTHER_LAYOUT = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}.*|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}.*|97[89][ -]?[0-9](?:[ -]?[0-9]){9}|[0-9]{1,5}-[0-9]{1,7}-[0-9]{1,6}-[0-9]")
#: Characters before a span that its check reads.
BEFORE = 32


def _plausible(kind: str, text: str, before: str = "") -> bool:
    """The exact check of a span that the network adds; `before`: up to BEFORE characters that stand before it.

    A telephone number without a plus sign needs the layout of one: separators between its groups, and
    neither the layout nor the name of another number, such as an ISBN or an order number.
    """
    digits = digits_of(text)
    if kind == "email":
        return bool(_EMAIL_LIKE.fullmatch(text))
    if kind == "ip":
        return bool(_IP_LIKE.fullmatch(text)) and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == "card":
        return bool(_CARD_LIKE.fullmatch(text)) and 16 <= len(digits) <= 19 and luhn(digits)
    if not (_PHONE_LIKE.fullmatch(text) and 9 <= len(digits) <= 15 and _GROUPS.search(text)):
        return False
    return text[0] == "+" or not (_OTHER_LAYOUT.fullmatch(text) or _NAMED.search(before))


# ---- characters and labelled texts

#: Fixed classes of characters: 0 is beyond the text's ends, 1 any other sign.
_CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " \t", "\n\r", "@", ".", "-", "+", "(", ")", "[]", ",;", ":", "/", "_", "%", '"\'', "=", "#$&*!|"]
_OF = np.ones(128, np.int64)
for _n, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _OF[ord(_c)] = _n + 2
LETTER = len(_CLASSES) + 2
VOCABULARY = LETTER + 1


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < 128, _OF[np.minimum(code, 127)], LETTER)


def labelled_text(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """Prose with personal data and look-alikes, and the spans of the former."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick("abcdefghiklmnoprstuvwzaeiouaeéèñöüß") for _ in range(int(rng.integers(1, 11))))
    plain = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9))))

    def card() -> str:
        body = number(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        groups = [body[i : i + 4] for i in range(0, 16, 4)]
        return pick([body, " ".join(groups), "-".join(groups), ".".join(groups)])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        local = pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a}/{b} {c}"])
        return pick(["", "+1 ", "+49 ", "+33 ", "1-"]) + local

    def email() -> str:
        name = pick([plain(), f"{plain()}.{plain()}", f"{plain()}{number(2)}", number(2), f"{plain()}_{plain()}"])
        host = pick([plain(), f"mail{number(1)}.{plain()}", f"{plain()}-{plain()}"]) + pick([".com", ".org", ".net", ".de", ".co.uk"])
        return pick([f"{name}@{host}"] * 4 + [f"{name} @ {host}", f"{name}(at){host}", f"{name} [at] {host}"])

    def ip() -> str:
        return pick([".", ".", ".", "[.]"]).join(str(x) for x in rng.integers(0, 256, 4))

    def other() -> str:
        return pick([number(16), number(int(rng.integers(1, 13))), "".join(pick("0123456789abcdef") for _ in range(40)), f"{number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", f"${number(3)}.{number(2)}", f"{number(2)}:{number(2)}", f"version {number(1)}.{number(1)}.{number(2)}", f"{number(3)},{number(3)}", f"@{plain()}", f"{plain()}{number(3)}", f"{number(1)}/{number(2)}"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    shout, text, spans = rng.random() < 0.1, "", []
    tail = pick([""] * 6 + ["!!", "###", "%%%", "***", "&&&", "$$$", " |"])
    while len(text) < WINDOW + 60:
        chance = rng.random()
        if chance < 0.14:
            kind = pick(KINDS)
            made = makers[kind]()
            spans.append((kind, len(text), len(text) + len(made)))
            text += made.upper() if shout else made
        elif chance < 0.24:
            text += other()
        else:
            w = word()
            text += w.upper() if shout else w.capitalize() if rng.random() < 0.15 else w
        text += pick(["", "", "", "", ",", ".", ":"]) + tail + pick([" "] * 8 + ["\n"])
    return text, spans


def sample(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = labelled_text(rng)
        at = int(rng.integers(-STRIDE // 2, len(text) - WINDOW))
        of, tag = classes(text), np.zeros(len(text), np.int64)
        for kind, a, z in spans:
            tag[a:z] = 2 + 2 * KINDS.index(kind)
            tag[a] -= 1
        a = max(at, 0)
        ids[i, a - at :], tags[i, a - at :] = of[a : at + WINDOW], tag[a : at + WINDOW]
    return ids, tags


# ---- the network


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """A bidirectional LSTM whose outputs are the CRF's emissions."""

    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        some = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": some(VOCABULARY, EMBED) * 2, "out": some(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"x{d}": some(EMBED, 4 * HIDDEN), f"h{d}": some(HIDDEN, 4 * HIDDEN), f"b{d}": bias}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        n, length, _ = x.shape
        put, h, c = x @ self.p[f"x{d}"] + self.p[f"b{d}"], np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((n, length, HIDDEN), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            gates = put[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g, before, prior = np.tanh(gates[:, 3 * HIDDEN :]), c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[:, t] = h
            if keep:
                kept.append((t, i, f, o, g, before, prior, squashed))
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["embed"][ids]
        both = np.concatenate([self._lstm(x, "f", False)[0], self._lstm(x, "b", False)[0]], axis=2)
        return both @ self.p["out"] + self.p["out_b"]

    def _step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of the CRF's likelihood, back through both directions."""
        n, length = ids.shape
        x = self.p["embed"][ids]
        runs = {d: self._lstm(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        emit, move = both @ self.p["out"] + self.p["out_b"], self.p["move"]
        # Forward and backward sums in scaled probabilities.
        high = emit.max(axis=2, keepdims=True)
        e, m = np.exp(emit - high), np.exp(move)
        alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((n, length), np.float32)
        alpha[:, 0] = e[:, 0]
        for t in range(length):
            if t:
                alpha[:, t] = (alpha[:, t - 1] @ m) * e[:, t]
            scale[:, t] = alpha[:, t].sum(axis=1)
            alpha[:, t] /= scale[:, t, None]
        beta[:, -1] = 1
        for t in range(length - 2, -1, -1):
            beta[:, t] = ((beta[:, t + 1] * e[:, t + 1]) @ m.T) / scale[:, t + 1, None]
        rows, times = np.arange(n)[:, None], np.arange(length)[None, :]
        score = emit[rows, times, tags].sum() + move[tags[:, :-1], tags[:, 1:]].sum()
        loss = (np.log(scale).sum() + high.sum() - score) / n
        g_emit = alpha * beta
        g_emit[rows, times, tags] -= 1
        pair = np.einsum("nti,ntj->ij", alpha[:, :-1], beta[:, 1:] * e[:, 1:] / scale[:, 1:, None]) * m
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        grad = {"move": pair / n, "out": np.einsum("nlh,nlt->ht", both, g_emit) / n, "out_b": g_emit.sum(axis=(0, 1)) / n}
        g_both, g_x = g_emit @ self.p["out"].T / n, np.zeros_like(x)
        for k, d in enumerate("fb"):
            g_out, wh = g_both[:, :, k * HIDDEN : (k + 1) * HIDDEN], self.p[f"h{d}"]
            g_gates, g_h, g_c = np.empty((n, length, 4 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            g_wh = np.zeros_like(wh)
            for t, i, f, o, g, before, prior, squashed in reversed(runs[d][1]):
                gh = g_out[:, t] + g_h
                g_c = g_c + gh * o * (1 - squashed**2)
                z = g_gates[:, t]
                z[:, :HIDDEN], z[:, HIDDEN : 2 * HIDDEN] = g_c * g * i * (1 - i), g_c * before * f * (1 - f)
                z[:, 2 * HIDDEN : 3 * HIDDEN], z[:, 3 * HIDDEN :] = gh * squashed * o * (1 - o), g_c * i * (1 - g**2)
                g_wh += prior.T @ z
                g_h, g_c = z @ wh.T, g_c * f
            grad |= {f"h{d}": g_wh, f"x{d}": np.einsum("nle,nlg->eg", x, g_gates), f"b{d}": g_gates.sum(axis=(0, 1))}
            g_x += g_gates @ self.p[f"x{d}"].T
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], ids, g_x)
        return float(loss), grad

    def train(self, steps: int = STEPS, batch: int = BATCH, seed: int = 11, rate: float = 0.02) -> Tagger:
        rng, first, second = np.random.default_rng(seed), {}, {}
        self.losses = []
        for t in range(1, steps + 1):
            loss, grad = self._step(*sample(rng, batch))
            self.losses.append(loss)
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grad.values()))) / 5)
            for k, g in grad.items():
                g = g / norm
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g**2
                pace = rate * min(1, 3 * (1 - t / (steps + 1)))
                self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of each window by Viterbi."""
        emit, move = self.emissions(ids), self.p["move"]
        n, length, _ = emit.shape
        back, score = np.empty((n, length, TAGS), np.int8), emit[:, 0]
        for t in range(1, length):
            paths = score[:, :, None] + move
            back[:, t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + emit[:, t]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags


#: What `python -m paceline.llm.pii` writes: the network as `Tagger().train()` leaves it (17 KB).
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")


@functools.lru_cache(maxsize=1)
def trained_tagger() -> Tagger:
    """The network of WEIGHTS; where they aren't there, or of another shape, it is trained first."""
    tagger = Tagger()
    if os.path.exists(WEIGHTS):
        with np.load(WEIGHTS) as kept:
            if {k: v.shape for k, v in kept.items()} == {k: v.shape for k, v in tagger.p.items()}:
                tagger.p = dict(kept.items())
                return tagger
    return tagger.train()


# ---- windows and their reconciliation


#: What a span must hold one of to pass its check.
_SIGN = re.compile(r"[0-9@]|\(at\)|\[at\]", re.IGNORECASE)


def _over(a: int, z: int, length: int) -> range:
    """Numbers of the windows that hold one of the characters from a to z, which is exclusive."""
    # Window k starts at k * STRIDE - edge; a character lies in WINDOW / STRIDE windows.
    edge = (WINDOW - STRIDE) // 2
    return range(max(0, (a + edge - WINDOW) // STRIDE + 1), min((z - 1 + edge) // STRIDE, (length - 1) // STRIDE) + 1)


def _windows(text: str, numbers: set[int] | None = None) -> tuple[np.ndarray, list[int]]:
    """Windows by number, or all that hold a sign: character classes, and the places they start at."""
    if numbers is None:
        numbers = {k for m in _SIGN.finditer(text) for k in _over(*m.span(), len(text))}
    if not numbers:
        return np.zeros((0, WINDOW), np.int64), []
    of = classes(text)
    padded = np.zeros(len(of) + 2 * WINDOW, np.int64)
    padded[WINDOW : WINDOW + len(of)] = of
    starts = np.array(sorted(numbers)) * STRIDE - (WINDOW - STRIDE) // 2
    return padded[starts[:, None] + WINDOW + np.arange(WINDOW)], [int(s) for s in starts]


def _pieces(row: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that a window's tags say."""
    out = []
    for t in np.flatnonzero(row).tolist():
        if out and t < out[-1][2]:
            continue
        kind, z = (int(row[t]) - 1) // 2, t + 1
        while z < WINDOW and row[z] == 2 + 2 * kind:
            z += 1
        out.append((kind, t, z))
    return out


def reconcile(starts: list[int], tags: Iterable[np.ndarray], length: int) -> list[tuple[str, int, int]]:
    """Spans of a text from its windows' tags, joined where those of a kind overlap or touch."""
    edge, found, tails = (WINDOW - STRIDE) // 2, [], []
    for start, row in zip(starts, tags, strict=True):
        for kind, a, z in _pieces(row):
            span = (kind, a + start, min(z + start, length))
            if edge <= a < edge + STRIDE:
                found += [span] if a + start < length else []
            # The window before ends at place WINDOW - STRIDE of this one. What goes on past
            # that is for this window to say: all of a span whose start it sees, else the tail.
            elif a < edge and z > WINDOW - STRIDE and a + start >= 0:
                if a:
                    found.append(span)
                else:
                    tails.append((kind, start + WINDOW - STRIDE, span[2]))
    joined: list[list[int]] = []
    own = set(found)
    for kind, a, z in sorted(own.union(tails)):
        if joined and joined[-1][0] == kind and a <= joined[-1][2]:
            joined[-1][2] = max(z, joined[-1][2])
        elif (kind, a, z) in own:
            joined.append([kind, a, z])
    return [(KINDS[k], a, z) for k, a, z in joined]


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """For each text the network's spans that overlap no base span and pass their check."""
    tags: list[dict[int, np.ndarray]] = [{} for _ in texts]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo: dict[int, set[int] | None] = dict.fromkeys(range(len(texts)))
    while todo:
        parts = [(n, *_windows(texts[n], numbers)) for n, numbers in todo.items()]
        todo = {}
        if not any(s for _, _, s in parts):
            break
        ids = np.concatenate([w for _, w, _ in parts])
        rows = iter(np.concatenate([tagger.decode(ids[i : i + 1024]) for i in range(0, len(ids), 1024)]))
        for n, _, starts in parts:
            fresh = dict(zip(starts, rows, strict=False))
            tags[n] |= fresh
            # A span found may go on, or be joined to one, in any window it reaches or touches.
            over = {k for s, row in fresh.items() for _, a, z in _pieces(row) for k in _over(s + a - 1, s + z + 1, len(texts[n]))}
            over = {k for k in over if k * STRIDE - (WINDOW - STRIDE) // 2 not in tags[n]}
            if over:
                todo[n] = over
    for n, (text, base) in enumerate(zip(texts, bases, strict=True)):
        for kind, a, z in reconcile(list(tags[n]), list(tags[n].values()), len(text)):
            while a < z and not (text[a].isalnum() or text[a] in "+(_"):
                a += 1
            while a < z and not (text[z - 1].isalnum() or text[z - 1] in "_"):
                z -= 1
            if a < z and all(z <= x or a >= y for _, x, y in base) and _plausible(kind, text[a:z], text[max(0, a - BEFORE) : a]):
                out[n].append((kind, a, z))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """A row for each row of `docs`: doc_id, base and spans, arrays of (kind, start, end).

    Places are code points, ends exclusive; both arrays go by kind (e-mail, IP address,
    card, phone), then start. Null and empty texts have no spans; repeated rows have the
    same; an empty table gives an empty result; further columns are not read.
    """
    tagger = tagger or trained_tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda found: pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in x] for x in found], kind)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = added_spans(texts, bases, tagger)
                every = [sorted(b + m, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) for b, m in zip(bases, more, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), rows(bases), rows(every)], ["doc_id", "base", "spans"])

    of = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return small_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))).mapInArrow(run, f"doc_id {of}, base {spans}, spans {spans}")


def op10_pii(spark, sf_dir):
    from pyspark.sql import functions as F

    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


if __name__ == "__main__":
    np.savez(WEIGHTS, **Tagger().train().p)
