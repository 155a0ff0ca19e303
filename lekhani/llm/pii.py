"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from importlib import resources
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match can't begin within digits: it would have begun with the first
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What makes a word worth the field's look: a digit, @, or a written-out at or dot, which reach further.
_TRIGGER = re.compile(r"[0-9@]+|[(\[](?:at|dot)[)\]]|(?<![^\x20\x09-\x0D])dot(?![^\x20\x09-\x0D])", re.IGNORECASE)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WHITE = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:  # the local part is the run of its characters before each @, after the match before
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple:
    return s[0], KINDS.index(s[2]), s[1]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the model -----------------------------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_DIM = 1 << 12
_SLOTS = 12


def cases(path: str | None = None) -> list[tuple[str, list[Span]]]:
    """The labelled cases of a file: texts with {kind|text} around spans; blank lines and lines with # don't count."""
    text = Path(path).read_text(encoding="utf-8") if path else resources.files(__package__).joinpath("pii_cases.txt").read_text(encoding="utf-8")
    out = []
    for line in text.splitlines():
        if line and not line.startswith("#"):
            plain, spans = "", []
            for part in re.split(r"(\{[a-z]+\|[^}]*\})", line):
                if part.startswith("{"):
                    kind, _, value = part[1:-1].partition("|")
                    spans.append((len(plain), len(plain) + len(value), kind))
                    part = value
                plain += part
            out.append((plain, spans))
    return out


def training_rows() -> list[tuple[str, list[Span]]]:
    """What the shipped field learns from: two of three cases of the file, and short texts made by rule."""
    return [x for i, x in enumerate(cases()) if i % 3] * 3 + labelled_rows()


def labelled_rows(n: int = 480, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Short texts made by rule, with the spans of personal data in them."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    words = ["the", "report", "of", "and", "page", "for", "is", "see", "about", "with", "la", "der", "que", "und", "les", "para"]

    def card() -> str:
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([" ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    make = {
        "email": lambda: f"{name()}{r.choice(['.', '_', ''])}{name()}{r.choice(['', digits(2)])}@{name()}.{r.choice(['com', 'org', 'co.uk', 'de'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
    }
    cue = {"email": ["mail", "contact", "write to", "e-mail:"], "ip": ["host", "address", "from", "server"], "card": ["card", "card no.", "paid with", "visa"], "phone": ["call", "phone", "tel.", "mobile:"]}
    other = [
        lambda: f"version {r.randint(1, 20)}.{r.randint(0, 30)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"${digits(3)},{digits(3)}.{digits(2)}",
        lambda: f"order {digits(r.randint(4, 12))}",
        lambda: f"{r.randint(1, 99)}%",
        lambda: f"{r.randint(1900, 2030)}",
        lambda: f"pages {digits(2)} - {digits(3)}",
        lambda: f"0x{digits(8)}",
        lambda: digits(16) + r.choice(["", "", "!!", "***", "%%%", "$$$"]),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{digits(1)}. ",
        lambda: f"{digits(1)}.{digits(1)}. ",
        lambda: f"id {name()}{digits(6)}",
        lambda: f"@{name()}",
        lambda: f"{digits(1)}.{digits(2)} {digits(3)} {digits(2)}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice(words) for _ in range(r.randint(1, 5))) + " "
            if r.random() < 0.5:
                text += r.choice(other)() + r.choice([" ", ". ", ", "])
            else:
                k = r.choice(KINDS)
                if r.random() < 0.6:
                    text += r.choice(cue[k]) + " "
                value = make[k]()
                spans.append((len(text), len(text) + len(value), k))
                text += value + r.choice([" ", ". ", ", "])
        if not spans and r.random() < 0.4:
            text = "".join(f"{w.upper()}!! " for w in text.split())
        out.append((text.rstrip(), spans))
    return out


def _shape(w: str) -> str:
    out = []
    for c in w[:40]:
        s = "d" if "0" <= c <= "9" else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _slot(kind: int, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{what}".encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % _DIM


def _features(words: list[str], i: int) -> list[int]:
    """Word shapes of a token and its neighbours, hashed."""
    w = words[i]
    before, after = (words[i - 1] if i else ""), (words[i + 1] if i + 1 < len(words) else "")
    n = sum("0" <= c <= "9" for c in w)
    near = re.sub(r"[^a-z]", "", before.lower())[:12]
    say = ["1", _shape(w), f"{_shape(w)}/{min(n, 20)}", str(min(n, 20)), str(w.count(".")), str("@" in w), w[0], w[-1], _shape(before)[:6], _shape(after)[:6], near, f"{_shape(before)[:4]}|{_shape(w)[:8]}|{_shape(after)[:4]}"]
    return [_slot(k, x) for k, x in enumerate(say)]


def _segments(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that are decoded together, apart from the rest of the text.

    Only words near a trigger can be part of a span: a word with a digit or @ and the word on either side, a
    written-out at or dot and five on either side. The words of a run are in order and none is in two runs.
    """
    out: list[list[tuple[int, int]]] = []
    last = 0  # where the last word taken ends
    for m in _TRIGGER.finditer(text):
        plain = m[0][0] in "0123456789@"
        reach = 1 if plain else 5
        if m.start() >= last or not plain:
            a = m.start()
            while a > last and text[a - 1] not in _WHITE:
                a -= 1
            some: list[tuple[int, int]] = []
            for _ in range(reach):  # words before, back to the last one taken
                b = a if not some else some[-1][0]
                while b > last and text[b - 1] in _WHITE:
                    b -= 1
                c = b
                while c > last and text[c - 1] not in _WHITE:
                    c -= 1
                if c == b:
                    break
                some.append((c, b))
            if a >= last and m.start() >= last:
                got = _WORD.match(text, m.end())
                some = [*some[::-1], (a, got.end() if got else m.end())]
            else:
                some = []
            for w in some:
                _take(text, out, w)
                last = w[1]
        own = _WORD.match(text, m.end())
        at, more = (own.end() if own else m.end()), reach
        while more:  # words behind
            w = _WORD.search(text, at)
            if w is None:
                break
            if w.start() >= last:
                _take(text, out, w.span())
                last = w.end()
            at, more = w.end(), more - 1
    return out


def _take(text: str, out: list[list[tuple[int, int]]], w: tuple[int, int]) -> None:
    if out and _near(text, out[-1][-1][1], w[0]):
        out[-1].append(w)
    else:
        out.append([w])


def _near(text: str, a: int, b: int) -> bool:
    """Whether only white space, a few characters of it, lies between two places."""
    return b - a <= 8 and not text[a:b].strip(_WHITE)


def _tokens(text: str, run: list[tuple[int, int]]) -> np.ndarray:
    """Features of a run's words; the words before and after it count as neighbours only."""
    a, b = run[0][0], run[-1][1]
    before = text[max(0, a - 60) : a].split()[-1:] or [""]
    after = text[b : b + 60].split()[:1] or [""]
    words = [*before, *(text[x:y] for x, y in run), *after]
    return np.array([_features(words, i) for i in range(1, len(words) - 1)], np.int64)


class Crf:
    """Weights of features and label pairs; labels may not go from O or another kind to an inside label."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @staticmethod
    def forbidden() -> np.ndarray:
        f = np.zeros((len(LABELS) + 1, len(LABELS)))  # the last row: before the first word
        for j, b in enumerate(LABELS):
            for i, a in enumerate((*LABELS, "O")):
                if b[0] == "I" and (a == "O" or a[2:] != b[2:]):
                    f[i, j] = -1e4
        return f

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run by Viterbi, runs of like length together in one array."""
        out: list = [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        t = self.t + self.forbidden()
        at = 0
        while at < len(order):
            longest = len(runs[order[at]])
            some = [order[at]]
            while at + len(some) < len(order) and len(runs[order[at + len(some)]]) <= longest * 1.25 + 2 and (len(some) + 1) * len(runs[order[at + len(some)]]) <= 200_000:
                some.append(order[at + len(some)])
            at += len(some)
            n = np.array([len(runs[i]) for i in some])
            x = np.zeros((len(some), n.max(), _SLOTS), np.int64)
            for row, i in enumerate(some):
                x[row, : n[row]] = runs[i]
            e = sum(self.w[x[..., s]] for s in range(_SLOTS))
            score, back = e[:, 0] + t[-1], np.zeros(e.shape, np.int8)
            for k in range(1, e.shape[1]):
                every = score[:, :, None] + t[None, :-1]
                back[:, k] = every.argmax(axis=1)
                score = np.where((k < n)[:, None], every.max(axis=1) + e[:, k], score)
            y = np.zeros(e.shape[:2], np.int8)
            end = score.argmax(axis=1)
            rows = np.arange(len(some))
            for k in range(e.shape[1] - 1, -1, -1):
                inside = k < n
                y[inside, k] = end[inside]
                if k:
                    end = np.where(inside, back[rows, k, end], end)
            for row, i in enumerate(some):
                out[i] = y[row, : n[row]]
        return out


def train(rows: list[tuple[str, list[Span]]], *, steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam on all runs of the labelled rows at once; the same rows give the same weights."""
    xs, ys = [], []
    for text, spans in rows:
        for run in _segments(text):
            y = []
            for a, b in run:
                hit = next((s for s in spans if a < s[1] and b > s[0]), None)
                first = hit is not None and not any(c < a and d > hit[0] for c, d in run)
                y.append(0 if hit is None else LABELS.index(f"{'B' if first else 'I'}-{hit[2]}"))
            xs.append(_tokens(text, run))
            ys.append(y)
    n = np.array([len(y) for y in ys])
    m, top, labels = len(ys), n.max(), len(LABELS)
    x, y = np.zeros((m, top, _SLOTS), np.int64), np.zeros((m, top), np.int64)
    for i in range(m):
        x[i, : n[i]], y[i, : n[i]] = xs[i], ys[i]
    mask = np.arange(top)[None] < n[:, None]
    model = Crf(np.zeros((_DIM, labels)), np.zeros((labels + 1, labels)))
    wall = Crf.forbidden()
    gold_w, gold_t = np.zeros_like(model.w), np.zeros_like(model.t)
    for s in range(_SLOTS):
        np.add.at(gold_w, (x[..., s][mask], y[mask]), 1)
    np.add.at(gold_t, (np.full(m, labels), y[:, 0]), 1)
    two = mask[:, 1:]
    np.add.at(gold_t, (y[:, :-1][two], y[:, 1:][two]), 1)

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        big = a.max(axis=axis, keepdims=True)
        return (big + np.log(np.exp(a - big).sum(axis=axis, keepdims=True))).squeeze(axis)

    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.w, model.t)]
    for step in range(1, steps + 1):
        e, t = model.w[x].sum(axis=2), model.t + wall
        f, b = np.zeros(e.shape), np.zeros(e.shape)
        f[:, 0] = e[:, 0] + t[-1]
        for k in range(1, top):
            f[:, k] = np.where(mask[:, k, None], lse(f[:, k - 1, :, None] + t[None, :-1], 1) + e[:, k], f[:, k - 1])
        for k in range(top - 2, -1, -1):
            b[:, k] = np.where(mask[:, k + 1, None], lse(t[None, :-1] + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * mask[..., None]
        want_w, want_t = np.zeros_like(model.w), np.zeros_like(model.t)
        for s in range(_SLOTS):
            np.add.at(want_w, x[..., s][mask], p[mask])
        want_t[-1] = p[:, 0].sum(axis=0)
        for k in range(1, top):
            q = f[:, k - 1, :, None] + t[None, :-1] + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None]
            want_t[:-1] += (np.exp(q) * mask[:, k, None, None]).sum(axis=0)
        for (one, two_), g, param in zip(state, ((gold_w - want_w) / m, (gold_t - want_t) / m), (model.w, model.t), strict=True):
            g = g - l2 * param
            one[:] = 0.9 * one + 0.1 * g
            two_[:] = 0.999 * two_ + 0.001 * g * g
            param += rate * (one / (1 - 0.9**step)) / (np.sqrt(two_ / (1 - 0.999**step)) + 1e-8)
    return model


_EDGES = " .,;:!?\"'<>[]{}|"


def find_all(texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; a span of the model is added where it meets no other."""
    base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    runs = [(i, run) for i, t in enumerate(texts) for run in _segments(t)]
    labels = model.decode([_tokens(texts[i], run) for i, run in runs])
    every = [list(s) for s in base]
    for (i, run), y in zip(runs, labels, strict=True):
        k = 0
        while k < len(y):
            name = LABELS[y[k]]
            if name[0] != "B":
                k += 1
                continue
            last = k
            while last + 1 < len(y) and LABELS[y[last + 1]] == f"I-{name[2:]}":
                last += 1
            a, b = run[k][0], run[last][1]
            k = last + 1
            while b > a and texts[i][b - 1] in _EDGES:
                b -= 1
            while a < b and texts[i][a] in _EDGES:
                a += 1
            if a < b and all(b <= s[0] or a >= s[1] for s in every[i]):
                every[i].append((a, b, name[2:]))
    return [(b, sorted(s, key=_order)) for b, s in zip(base, every, strict=True)]


def find(docs: DataFrame, *, labelled: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """Personal data in every text.

    The base patterns decide n_* and base_sha256; the model, trained on ``labelled`` rows (text, [(start, end, kind)]),
    adds spans that overlap no other: phone numbers without a plus, written-out or spaced e-mail addresses, broken IP
    addresses. By default it learns from ``training_rows``. Offsets are code points, ends exclusive.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all), n_added. Null text is empty; an empty
    text has no spans and the hash of the empty string; rows that repeat are separate rows; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = train(training_rows() if labelled is None else labelled)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for base, every in find_all([t or "" for t in f["text"]], model):
                n = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)
