"""Token counts of texts by public tokenizers, for several at once.

A text falls into units at places where none of the tokenizers joins what stands on both sides, and the counts of units
are added up; a unit's counts are remembered, so that a library sees each of them about once. A cut stands only between
two ASCII characters or before ASCII white space: before a run of white space, before its last character where that is
no blank, after a single tab or line feed, and between letters, digits and other signs, but not between an apostrophe
and a letter (contractions). Other characters hang together with the runs at both their sides.

Whether cuts are safe is looked up in a tokenizer's file (form_of). Tokenizers of another form, and texts with control
characters, carriage returns, other white space or U+2581, are counted whole by their library.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import islice

import numpy as np

SIGNS = r"!-/:-@\[-`{-~"
RUN = rf"(?:[A-Za-z]++|[0-9]++|[{SIGNS}]++(?:(?<=')[A-Za-z]++)?+)"
WIDE = r"[^\x00-\x7f]"
#: The first two alternatives are what the fifth would find, for the usual case.
UNIT = re.compile(
    rf" ?+[A-Za-z]++(?!{WIDE})| ?+[{SIGNS}]++(?<!')(?!{WIDE})"
    r"|[ \t\n]+(?=[\t\n][^ \t\n])|[\t\n](?=[^ \t\n])"
    rf"|[ \t\n]*+(?:{RUN}(?:{WIDE}++{RUN}?+)*+|(?:{WIDE}++{RUN}?+)++)|[ \t\n]++",
)
#: Texts with these are counted whole.
ODD = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f᠎▁﻿]|[^\S \t\n]")
#: One word of any tokenizer with a form.
LETTERS, DIGITS = re.compile(r" ?[A-Za-z]+").fullmatch, re.compile(r" ?[0-9]+").fullmatch

#: Units remembered by a worker (as many again of the time before), none longer than LONG_UNIT; units walked at a time.
KEPT_UNITS = 400_000
LONG_UNIT = 40
STRIDE = 200_000
#: Marks the first unit of a text, before which some tokenizers put a blank.
FIRST = "\0"

BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False}
FORMS = {
    "byte": (None, BYTE_LEVEL | {"use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                BYTE_LEVEL | {"use_regex": False},
            ],
        },
    ),
}


def form_of(name: str, blob: bytes) -> str | None:
    """byte, word or piece, where units may be counted apart; else None."""
    if name.endswith(".model"):
        return "piece" if pieces_apart(blob) else None
    file = json.loads(blob)
    model = file["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not file.get("truncation") and not file.get("padding")
    if not plain or not all(t["special"] for t in file["added_tokens"]):
        return None
    parts = json.loads(json.dumps([file["normalizer"], file["pre_tokenizer"]]), object_hook=lambda x: {k: v for k, v in x.items() if k != "trim_offsets"})
    return next((form for form, own in FORMS.items() if list(own) == parts), None)


def pieces_apart(blob: bytes) -> bool:
    """True for a BPE over the text as it is, with all bytes, none of whose pieces reaches over a cut."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(blob)
    n, t = m.normalizer_spec, m.trainer_spec
    kinds = m.SentencePiece
    as_it_is = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    if t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix or not as_it_is or n.normalization_rule_tsv:
        return False
    if not {p.type for p in m.pieces} <= {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}:
        return False
    texts = [p.piece.replace("▁", " ") for p in m.pieces if p.type == kinds.NORMAL]
    # pieces with odd characters are not found in the texts that are cut
    return all(len(UNIT.findall(x)) == 1 and not re.search(r"[\t\n]|[^ ] ", x) for x in texts if not ODD.search(x))


def token_counter(name: str, blob: bytes):
    """A function from texts to token counts, for a tokenizer file's bytes."""
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tk = Tokenizer.from_str(blob.decode("utf-8"))
    tk.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tk.encode_batch_fast(texts, add_special_tokens=False)]


def unit_counter(name: str, blob: bytes, form: str):
    """A function from units to token counts, for a tokenizer file of a form."""
    whole = token_counter(name, blob)
    if form == "piece":
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(blob)
        m.normalizer_spec.add_dummy_prefix = False
        inner = token_counter(name, m.SerializeToString())

        def pieces(units: list[str]) -> list[int]:
            got = inner(units)
            at = [i for i, u in enumerate(units) if u[0] == FIRST]
            for i, n in zip(at, whole([units[i][1:] for i in at]) if at else []):
                got[i] = n
            return got

        return pieces
    from tokenizers import Tokenizer

    one = Tokenizer.from_str(blob.decode("utf-8")).model.tokenize
    digit = {d: len(one(d)) for d in "0123456789"}

    def words(units: list[str]) -> list[int]:
        got, rest = [], []
        for i, u in enumerate(units):
            if u[0] == FIRST:
                u = u[1:]
            if LETTERS(u):
                got.append(len(one(u.strip().lower() if form == "word" else u.replace(" ", "Ġ"))))
            elif DIGITS(u):
                got.append(sum(map(digit.__getitem__, u.strip())) if form == "word" else len(one(u.replace(" ", "Ġ"))))
            else:
                got.append(0)
                rest.append((i, u))
        for (i, _), n in zip(rest, whole([u for _, u in rest]) if rest else []):
            got[i] = n
        return got

    return words


class Counts:
    """Token counts by several tokenizers; files: name and bytes, forms: what form_of says of them."""

    def __init__(self, files: dict[str, tuple[str, bytes]], forms: dict[str, str | None]):
        self.whole = {n: token_counter(*x) for n, x in files.items()}
        self.by_unit = {n: unit_counter(*x, forms[n]) for n, x in files.items() if forms[n]}
        self.forget()

    def forget(self) -> None:
        self.now: dict[str, int] = {}  # the row of a unit's counts
        self.before: dict[str, int] = {}
        self.row_of: dict[tuple, int] = {}
        self.rows = np.zeros((0, len(self.by_unit)), np.int64)

    def learn(self, units: list[str]) -> None:
        row_of = self.row_of
        for u, row in zip(units, zip(*[f(units) for f in self.by_unit.values()])):
            self.now[u] = row_of.setdefault(row, len(row_of))
        if len(row_of) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.array(list(islice(row_of, len(self.rows), None)), np.int64)])

    def unit_sums(self, units: list[str], lens: list[int]) -> np.ndarray:
        """(texts, tokenizers): counts added up over each text's units, the first of lens the first text's."""
        new = set(units).difference(self.now)
        known = new & self.before.keys()
        self.now.update((u, self.before[u]) for u in known)
        if new := list(new - known):
            self.learn(new)
        rows = np.fromiter(map(self.now.__getitem__, units), np.int64, len(units))
        ends = np.cumsum([0, *lens])
        sums = np.zeros((len(units) + 1, len(self.by_unit)), np.int64)
        np.cumsum(self.rows[rows], axis=0, out=sums[1:])
        for u in new:
            if len(u) > LONG_UNIT:
                del self.now[u]
        if len(self.row_of) > KEPT_UNITS:
            self.forget()
        elif len(self.now) > KEPT_UNITS:
            self.now, self.before = {}, self.now
        return sums[ends[1:]] - sums[ends[:-1]]

    def __call__(self, texts: list[str]) -> dict[str, list[int]]:
        got = np.zeros((len(texts), len(self.by_unit)), np.int64)
        units: list[str] = []
        walked: list[tuple[int, int]] = []  # text, units

        def settle() -> None:
            if units:
                np.add.at(got, [i for i, _ in walked], self.unit_sums(units, [n for _, n in walked]))
            units.clear()
            walked.clear()

        odd = [i for i, t in enumerate(texts) if ODD.search(t)] if self.by_unit else []
        apart = set(odd)
        for i, t in enumerate(texts if self.by_unit else []):
            if i in apart or not t:
                continue
            found = UNIT.findall(t) if len(t) < STRIDE else (m.group() for m in UNIT.finditer(t))
            walk, first = iter(found), FIRST
            while part := list(islice(walk, STRIDE)):
                part[0] = first + part[0]
                first = ""
                units += part
                walked.append((i, len(part)))
                if len(units) >= STRIDE:
                    settle()
        settle()
        out = {n: got[:, k].tolist() for k, n in enumerate(self.by_unit)}
        for n, count in self.whole.items():
            if n not in out:
                out[n] = count(texts)
            elif odd:
                for i, c in zip(odd, count([texts[i] for i in odd])):
                    out[n][i] = c
        return out


_kept: dict[tuple, Counts] = {}


def counts_of(files: dict[str, tuple[str, bytes]], forms: dict[str, str | None]) -> Counts:
    """The counts of these files in this process: tasks that follow each other in a worker share what it remembers."""
    key = tuple((n, f, forms[n], hashlib.sha256(blob).hexdigest()) for n, (f, blob) in files.items())
    if key not in _kept:
        _kept.clear()
        _kept[key] = Counts(files, forms)
    return _kept[key]
