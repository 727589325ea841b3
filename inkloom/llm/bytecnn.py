"""A byte convolutional network for language identification, in numpy.

Fixed-length windows of UTF-8 bytes go through an embedding, filters of several widths, a rectifier, max pooling over
positions, and a softmax. It is trained here, on labelled text, by Adam on the cross-entropy; nothing is pretrained.
"""

from __future__ import annotations

import ctypes
import re
import unicodedata as ud
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np

from inkloom.llm.canonical import LOOK_ALIKES, folded

LANGUAGES = ["de", "en", "es", "fr", "it", "pt", "ru"]
#: The class of all other languages, trained on sentences whose letters were exchanged.
OTHER_LANGUAGE = "other"
CLASSES = [*LANGUAGES, OTHER_LANGUAGE]
WINDOW = 64
STRIDE = 48
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 40

MARKUP = re.compile(r"<[^<>]*>|\{\{\d+\}\}|@@\d+@@|&#?\w+;")
#: A sentence ends at its stop and closing quotes before a blank and no small letter or closing sign; a line break ends
#: one too.
SENTENCE = re.compile(r"[^\n]+?(?:[.!?…]+[\"'”“»’)\]]*(?=\s+[^\s)\],;:a-zß-öø-ÿа-яё]|\s*$)|(?=\n|$))")
RUNS = re.compile("[ \t]+")
LETTERS = re.compile(r"[^\W\d_]+")
OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f]")
LATIN = re.compile("[A-Za-zÀ-ɏ]")


@lru_cache(maxsize=4096)
def form(c: str) -> str:
    """Wide forms, blanks, ligatures and invisible characters in their plain form; letters as they are."""
    return c if c in LOOK_ALIKES or ud.decomposition(c)[:1] not in ("", "<") else folded(c)


class _Forms(dict):
    """Code points to plain forms, filled as they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = got = form(chr(code))
        return got


FORMS = _Forms()


def one_script(m: re.Match) -> str:
    """A word of Latin letters and look-alikes of other scripts in Latin only; a word with a letter that only another
    script has is left as it is."""
    word = m.group()
    if word.isascii() or not LATIN.search(word):
        return word
    folded_word = "".join(LOOK_ALIKES.get(c, c) for c in word)
    return word if OTHER.search(folded_word) else folded_word


def plain(text: str) -> str:
    """Text without markup and placeholders, with one form of blanks, wide and look-alike letters."""
    text = MARKUP.sub(" ", text)
    if not text.isascii():
        text = ud.normalize("NFC", text.translate(FORMS))
        if LATIN.search(text) and OTHER.search(text):
            text = LETTERS.sub(one_script, text)
    return RUNS.sub(" ", text)


def letter_class(test: Callable[[str], bool]) -> str:
    """The letters that pass a test, as the ranges of a character class."""
    codes = [c for c in range(0x1E944) if test(chr(c)) and chr(c).isalpha()]
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


UPPER, LOWER = letter_class(lambda c: c.isupper() or c.istitle()), letter_class(str.islower)
NO_LETTER = r"(?<![^\W\d_])"
CAPITALISED = re.compile(rf"{NO_LETTER}[{UPPER}][^\W\d_]*")
CAPITALS = re.compile(rf"{NO_LETTER}[{UPPER}]{{2,}}(?![^\W\d_])")
SMALL = re.compile(rf"{NO_LETTER}[{LOWER}]")
SMALL_WORD = re.compile(rf"{NO_LETTER}[{LOWER}][^\W\d_]+")
CASELESS = re.compile(rf"{NO_LETTER}(?![{UPPER}{LOWER}])[^\W\d_]+")


def core(sentence: str) -> str:
    """The sentence in lower case without its capitalised words, as names say nothing about a language; a sentence in
    capitals keeps all of them."""
    if len(CAPITALS.findall(sentence)) > len(SMALL.findall(sentence)):
        return sentence.lower()
    return RUNS.sub(" ", CAPITALISED.sub("", sentence))


def worth(sentence: str) -> bool:
    """Whether there are words to tell a language by: beside names (capitalised words) and numbers. Scripts without
    capitals, some of them without blanks between words, are judged by their letters."""
    if len(SMALL_WORD.findall(sentence)) >= 2 or len(CAPITALS.findall(sentence)) >= 3:
        return True
    return not sentence.isascii() and sum(map(len, CASELESS.findall(sentence))) >= 4


#: Letters that are exchanged for each other in the sentences of no language.
EXCHANGED = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"]


def no_language(sentence: str, rng: np.random.Generator) -> str:
    """The sentence with vowels and consonants exchanged at random: the look of words, in no language known."""
    table: dict[int, str] = {}
    for letters in EXCHANGED:
        to = [letters[k] for k in rng.permutation(len(letters))]
        table |= {ord(a): b for a, b in zip(letters, to)} | {
            ord(a.upper()): b.upper() for a, b in zip(letters, to) if len(a.upper()) == len(b.upper()) == 1
        }
    return sentence.translate(table)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out = []
    for m in SENTENCE.finditer(text):
        start, end = m.span()
        while start < end and text[start].isspace():
            start += 1
        if start < end:
            out.append((start, end))
    return out


def windows(text: str) -> list[bytes]:
    """Fixed-length windows of a text's bytes, the last padded with zeros."""
    raw = f" {core(text)} ".encode("utf-8", "replace")
    return [raw[at : at + WINDOW].ljust(WINDOW, b"\0") for at in range(0, max(1, len(raw) - WINDOW + STRIDE), STRIDE)]


def as_array(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), WINDOW)


class ByteCnn:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, n_out: int, seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            p[f"f{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            p[f"b{w}"] = np.zeros(FILTERS)
        p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_out))
        p["bias"] = np.zeros(n_out)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def forward(self, x: np.ndarray, keep: bool = False):
        p, pooled, kept = self.p, [], {}
        e = p["embed"][x]
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x) * n, w * EMBED)
            h = (cols @ p[f"f{w}"]).reshape(len(x), n, FILTERS)
            if keep:
                at = h.argmax(1)
                top = np.take_along_axis(h, at[:, None, :], 1)[:, 0] + p[f"b{w}"]
                kept[w] = (cols, at, top)
            else:
                top = h.max(1) + p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
        z = np.concatenate(pooled, 1)
        logits = z @ p["out"] + p["bias"]
        logits -= logits.max(1, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(1, keepdims=True)
        return (probs, z, kept) if keep else probs

    def predict(self, x: np.ndarray, batch: int = 96) -> np.ndarray:
        """Probabilities of windows. Each distinct one goes through the network once, with others of its length: all
        places beyond the end and the widest filter look alike, so they are left out."""
        if not len(x):
            return np.zeros((0, len(self.p["bias"])), np.float32)
        rows, back = np.unique(np.ascontiguousarray(x).view(f"V{WINDOW}").ravel(), return_inverse=True)
        rows = rows.view(np.uint8).reshape(-1, WINDOW)
        used = WINDOW - (rows[:, ::-1] != 0).argmax(1)
        order = np.argsort(used, kind="stable")
        out = np.empty((len(rows), len(self.p["bias"])), np.float32)
        for i in range(0, len(rows), batch):
            at = order[i : i + batch]
            out[at] = self.forward(rows[at, : min(WINDOW, int(used[at[-1]]) + max(WIDTHS))])
        return out[back.ravel()]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        probs, z, kept = self.forward(x, keep=True)
        d = probs
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": z.T @ d, "bias": d.sum(0)}
        dz = d @ self.p["out"].T
        ge = np.zeros((256, EMBED), np.float32)
        rows = np.arange(len(x))
        for k, w in enumerate(WIDTHS):
            cols, at, top = kept[w]
            n = WINDOW - w + 1
            dt = dz[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
            # only the pooled positions carry a gradient
            picked = cols[(rows[:, None] * n + at).ravel()].reshape(len(x), FILTERS, w * EMBED)
            g[f"f{w}"] = np.einsum("nfe,nf->ef", picked, dt, optimize=True)
            g[f"b{w}"] = dt.sum(0)
            dc = dt[:, :, None] * self.p[f"f{w}"].T[None]
            for j in range(w):
                seen = x[rows[:, None], at + j].ravel()
                for e in range(EMBED):
                    ge[:, e] += np.bincount(seen, dc[:, :, j * EMBED + e].ravel(), 256)
        g["embed"] = ge
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 4e-3, batch: int = 64, seed: int = 11) -> ByteCnn:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        t, n, mean = 0, 0, {k: np.zeros_like(q) for k, q in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                s = order[i : i + batch]
                t += 1
                step = rate * 0.7**epoch
                for k, g in self.gradients(x[s], y[s]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                # the mean over the later steps is steadier than the last one
                if 2 * epoch >= epochs:
                    n += 1
                    for k, q in self.p.items():
                        mean[k] += q
        if n:
            self.p = {k: (q / n).astype(self.p[k].dtype) for k, q in mean.items()}
        return self

    def texts(self, texts: list[str]) -> np.ndarray:
        """Probabilities of whole texts: the mean of their windows' log-probabilities, normalised."""
        parts = [windows(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        if not len(owner):
            return np.zeros((0, len(self.p["bias"])), np.float32)
        logs = np.log(self.predict(as_array([w for p in parts for w in p])) + 1e-7)
        sums = np.zeros((len(texts), logs.shape[1]), np.float64)
        np.add.at(sums, owner, logs)
        sums /= np.bincount(owner, minlength=len(texts))[:, None]
        e = np.exp(sums - sums.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


@contextmanager
def one_thread() -> Iterator[None]:
    """Keeps the linear algebra library to one thread: the matrices are small, and its threads would wait on each other
    and on the engine's. Does nothing where the library offers no such switch."""
    switches = []
    try:
        for path in {line.split()[-1] for line in Path("/proc/self/maps").read_text().splitlines() if "openblas" in line}:
            lib = ctypes.CDLL(path)
            for name in ("{}_num_threads64_", "{}_num_threads"):
                for prefix in ("scipy_openblas", "openblas"):
                    get, put = (getattr(lib, name.format(f"{prefix}_{verb}"), None) for verb in ("get", "set"))
                    if get and put:
                        switches.append((put, get()))
    except OSError:
        pass
    for put, _ in switches:
        put(1)
    try:
        yield
    finally:
        for put, before in switches:
            put(before)


def balanced(y: np.ndarray, n_out: int, per_class: int, seed: int) -> np.ndarray:
    """Places of ``per_class`` rows of every class that occurs, repeated where it has fewer."""
    rng = np.random.default_rng(seed)
    have = [np.flatnonzero(y == k) for k in range(n_out)]
    return np.concatenate([np.concatenate([rng.permutation(h) for _ in range(-(-per_class // len(h)))])[:per_class] for h in have if len(h)])


def fit(texts: list[str], labels: list[int], groups: list, n_out: int, per_class: int = 3000, epochs: int = 6) -> ByteCnn:
    """A network from texts whose labels belong to groups (books, runs) and are wrong for some groups.

    A first network, trained on the labels as given, says which language a group is in; the final one is trained on
    the texts whose group and own prediction agree, and has one class more, the last: of texts in no language known."""
    with one_thread():
        return _fit(texts, np.asarray(labels), groups, n_out, per_class, epochs)


def _fit(texts: list[str], y: np.ndarray, groups: list, n_out: int, per_class: int, epochs: int) -> ByteCnn:
    x = as_array([windows(t)[0] for t in texts])
    rows = balanced(y, n_out, per_class, 3)
    p = ByteCnn.fresh(n_out).train(x[rows], y[rows], 2).predict(x)
    rng = np.random.default_rng(17)
    index = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    owner = np.fromiter((index[g] for g in groups), np.int64, len(groups))
    votes = np.zeros((len(index), n_out))
    np.add.at(votes, owner, np.log(p + 1e-3))
    said = votes.argmax(1)[owner]
    good = np.flatnonzero((p.argmax(1) == said) | (p[np.arange(len(y)), said] > 0.2))
    rows = good[balanced(said[good], n_out, per_class, 5)]
    none = as_array([windows(no_language(texts[i], rng))[0] for i in rng.choice(rows, min(len(rows), per_class), replace=False)])
    return ByteCnn.fresh(n_out + 1).train(np.concatenate([x[rows], none]), np.concatenate([said[rows], np.full(len(none), n_out)]), epochs)
