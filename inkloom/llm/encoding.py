"""Problem 2: text garbled by a wrong character encoding.

A record (a block's text, a book's title) is clean or went through one of a list of *chains*: its bytes, in the true
encoding, were read in a wrong one, once or twice. Chains are undone token by token. The corpus is reduced to its
distinct tokens first: each is undone and weighed once, by its frequency as a word (exact counts, joined) and by a
model of character trigrams counted over all tokens. How much likelier a token is with a chain undone is evidence,
weak for a word or two, so expectation-maximization pools it: the share of every chain in a field, and in each source
(book) and field, is estimated from the posteriors of the records, and is the prior of the next round. A record is
garbled where its posterior of being clean is below one half, and is repaired by its likeliest chain.

A record's evidence is one row with an array of chains; a round is one pass over these rows, a small aggregate by
source and one of at most (fields x chains) rows. All thresholds are shares of the corpus or log-likelihoods, so that
a larger corpus is judged alike; trigram counts are kept in tables of fixed size, several hashes each, of which the
least counts, so that an error is a fixed share of the corpus as well.

Texts are inner markup: character references are read as their characters (``opened``) wherever tokens are counted,
weighed or undone; a repair keeps the references of what it does not change. What only *looks* like another text
(hard spaces, invisible characters, look-alike letters) is no wrong encoding: a token is weighed in its plain form
too, and the likelier of both is what a chain has to beat.

Replacement characters (U+FFFD) and stray C1 controls are traces of a wrong encoding as well, restorable or not; so
are those that come out where a chain of UTF-8 is undone. (Other chains only give controls for bytes that the true
encoding does not have: they are no readings of the text.)

Defined results: null and empty texts are clean; of repeated rows of one key the greatest counts; rows without key
are left out. ``restored`` is null where nothing could be undone.
"""

from __future__ import annotations

import re
import unicodedata as ud
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.bytecnn import LETTERS, form, one_script
from inkloom.llm.canonical import LOOK_ALIKES
from inkloom.session import checked_broadcast, cut, latest_blocks, small_side, stored

#: Fixed values: (wrong encoding the bytes were read in, true encoding) of the chains; "x+y" is y undone after x.
CHAINS = [
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp1250", "utf-8"), ("mac_roman", "utf-8"),
    ("cp437", "utf-8"), ("cp850", "utf-8"), ("koi8-r", "utf-8"), ("cp866", "utf-8"), ("cp1252+cp1252", "utf-8"),
    ("latin-1+latin-1", "utf-8"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
    ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp1252", "mac_roman"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("koi8-r", "cp1251"),
    ("cp866", "cp1251"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp1251", "koi8-r"), ("cp1252", "koi8-r"),
    ("cp866", "koi8-r"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("koi8-r", "cp866"),
]

NAMES = [f"{w}>{t}" for w, t in CHAINS]
LOST = "lost"

#: Places of a table of counts, and how many tables (hashes) trigrams and pairs of characters have.
BUCKETS = 1 << 20
TRI, BI = 3, 2
#: Counts that smooth the model, and how often a repair's characters must occur: some, and a share of the corpus.
SMOOTH, SMOOTH_SHARE = 4.0, 5e-7
LEAST_SEEN, LEAST_SHARE = 3, 3e-7
#: How likely a token is to be parted by a blank other than the usual one.
BLANK_SHARE = 0.01
#: Least gain (nats) for a word to count as evidence, and the weight of the field's share in a source's prior.
WORD_GAIN = 2.5
FIELD_WEIGHT = 300.0
ROUNDS = 4
#: Times the garbled text found so far is taken from the model's counts, and the suspects weighed again.
CLEANINGS = 2
#: A word's gain counts up to this, and by so much of what is beyond: no single word is certain.
MOST_GAIN, BEYOND = 14.0, 0.02
#: In a record that is garbled by a chain, words are undone from this gain on.
REPAIR_GAIN = -2.0

MULTIBYTE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
AROUND = " .,;:!?()[]\"'«»“”„’‘…\xa0"
LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f]")
PLAUSIBLE = re.compile("[\xa0-\u017f\u0400-\u045f\u2010-\u203a\u20ac\u2122]")
TRACE = re.compile("[\x80-\x9f�]")
#: In Cyrillic texts a word's last letter and its punctuation, not a control's two bytes in cp1251.
ENDS_IN_VE = re.compile("В(?=[‚„…‹›‘’“”–—™])")
#: What parts tokens, and what parts a token into words.
SPACES = re.compile("[ \t\r\n]+")
INNER = re.compile("[ \xa0\u2000-\u200a\u202f\u205f\u3000]+")
#: A blank within a token that parts no words: at an end, or beside another one.
BARE = re.compile(f"^{INNER.pattern}|{INNER.pattern[:-1]}{{2}}|{INNER.pattern}$")
REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
#: References to these stay: they are markup's own, or would part words.
KEPT = set('&<>" \t\n\r\f')


@lru_cache(maxsize=None)
def referred(ref: str) -> str:
    """The characters a reference stands for, or the reference itself where it stays."""
    got = unescape(ref) if ref[1] == "#" else html5.get(ref[1:], ref)
    return ref if not got or got in KEPT else got


def opened(text: str) -> str:
    """The text with its character references read, all but those of markup's own characters; the same words by blanks."""
    return REFERENCE.sub(lambda m: referred(m.group()), text) if "&" in text else text


def closed(raw: str, new: str) -> str:
    """A repaired word, where nothing was changed as it stands in the raw one."""
    word = opened(raw)
    if word == raw:
        return new
    spots, at = [], 0  # for each character read, what stands for it
    for m in REFERENCE.finditer(raw):
        got = referred(m.group())
        spots += [*raw[at : m.start()], *([m.group()] if len(got) == 1 else m.group() if got == m.group() else [m.group(), *[""] * (len(got) - 1)])]
        at = m.end()
    spots += raw[at:]
    out, before = [], ""
    for kind, a, b, c, d in SequenceMatcher(None, word, new, False).get_opcodes():
        # what follows a deleted lead is the sequence's own character, not an old one
        out += [new[c], *spots[a + 1 : b]] if kind == "equal" and before == "delete" else spots[a:b] if kind == "equal" else new[c:d]
        before = kind
    return "".join(out)


@lru_cache(maxsize=None)
def to_bytes(codec: str) -> dict[int, str]:
    """Translation of a wrong decoding's characters to their bytes, as characters of the same number."""
    table: dict[int, str] = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)  # undefined places are commonly passed through
        table[ord(ch)] = chr(b)
    return table


@lru_cache(maxsize=None)
def from_bytes(codec: str) -> dict[int, str]:
    return {ord(v): chr(k) for k, v in to_bytes(codec).items()}


@lru_cache(maxsize=None)
def shadow(codec: str) -> dict[int, str | None]:
    """For characters 128..255 that the codec itself does not have: no byte, hence a mark that fits no pattern."""
    have = to_bytes(codec)
    return {c: "Ā" for c in range(128, 256) if c not in have}


def undo_utf8(word: str, wrong: str) -> str:
    """Replaces what were multi-byte sequences of UTF-8; an unfitting rest stays."""
    raw = word.translate(shadow(wrong) | to_bytes(wrong))
    out, at, changed = [], 0, False
    for m in MULTIBYTE.finditer(raw):
        try:
            ch = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [word[at : m.start()], ch]
        at, changed = m.end(), True
    if not changed:
        return word
    return "".join(out) + word[at:]


@lru_cache(maxsize=None)
def single(wrong: str, true: str) -> dict[int, str]:
    there, back = to_bytes(wrong), from_bytes(true)
    return {c: back.get(ord(b), b) for c, b in there.items()}


@lru_cache(maxsize=None)
def ranges() -> list[tuple[int, str, str, frozenset | None]]:
    """(number, wrong, true, characters a single-byte chain has) of every chain."""
    return [(n, w, t, None if t == "utf-8" else frozenset(map(chr, single(w, t)))) for n, (w, t) in enumerate(CHAINS)]


def mixes_scripts(word: str) -> bool:
    """Latin letters beside those of another alphabet."""
    return bool(LATIN.search(word)) and bool(OTHER.search(word))


def undo(word: str, wrong: str, true: str) -> str:
    """The word before the chain, or the word itself where the chain does not apply."""
    if true == "utf-8":
        new = word
        for w in wrong.split("+"):
            before, new = new, undo_utf8(new, w)
            if new == before:
                return word
        return new
    table = single(wrong, true)
    if any(ord(c) > 127 and ord(c) not in table for c in word):
        return word
    return word.translate(table)


def readings(token: str) -> tuple[list[tuple[int, str]], bool, bool]:
    """(chain, token undone) of all chains that apply; whether characters were lost; whether it has sequences of UTF-8
    that stand for Latin or Cyrillic letters or punctuation, as only a wrong encoding makes them."""
    got: list[tuple[int, str]] = []
    lost, sequences, mixed = bool(TRACE.search(token)), False, mixes_scripts(token)
    beyond = frozenset(c for c in token if c > "\x7f")
    for n, wrong, true, have in ranges():
        if have is not None and not beyond <= have:
            continue
        new = undo(token, wrong, true)
        if new == token:
            continue
        if TRACE.search(new):
            lost = lost or true == "utf-8" and bool(TRACE.search(undo(ENDS_IN_VE.sub("", token), wrong, true)))
            continue
        if not mixed and mixes_scripts(new) or BARE.search(new) and not BARE.search(token):
            continue
        got.append((n, new))
        if true == "utf-8" and "+" not in wrong and all(c in token or PLAUSIBLE.match(c) for c in new):
            sequences = True
    return got, lost, sequences


def plain_form(token: str) -> str:
    """The token with wide, invisible and look-alike characters in their plain form."""
    text = ud.normalize("NFC", "".join(c if c < "\x80" else form(c) for c in token))
    if mixes_scripts(text):
        return LETTERS.sub(one_script, text)
    latin = "".join(LOOK_ALIKES.get(c, c) for c in text)
    return text if OTHER.search(latin) else latin


def words_of(token: str) -> set[str]:
    """The token, and it and its words without the punctuation around them."""
    return {token, *(p.strip(AROUND) for p in (token, *INNER.split(token)))} - {""}


# --- the model


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each with two blanks before and one after it; where each begins."""
    raw = np.frombuffer("".join(f"  {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return raw, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 3)])


def places(codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Table places of all trigrams and of all pairs of neighbours, a list of each by hash."""
    with np.errstate(over="ignore"):
        c = codes + np.uint64(1)
        two = (c[:-1] << np.uint64(21)) ^ c[1:]
        three = (two[:-1] * np.uint64(2654435761)) ^ c[2:]

        def mixed(x: np.ndarray, odd: int) -> np.ndarray:
            x = (x ^ (x >> np.uint64(29))) * np.uint64(odd)
            return ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

        odd = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
        return [mixed(three, odd[k]) for k in range(TRI)], [mixed(two, odd[k]) for k in range(BI)]


#: Places a part of a table on the way to the driver has.
PART = 1 << 16
#: Code points that a table of single characters has.
CHARACTERS = 0x110000


def counted(rows: Iterable[tuple[list[str], list[int]]]) -> Iterator[tuple[int, np.ndarray]]:
    """(number, counts) of the tables over (tokens, their numbers): trigrams, pairs, single characters."""
    tables = [np.zeros(BUCKETS, np.int64) for _ in range(TRI + BI)]
    single_characters = np.zeros(CHARACTERS, np.int64)
    for texts, numbers in rows:
        if not texts:
            continue
        c, starts = padded(texts)
        weight = np.repeat(np.asarray(numbers, np.int64), np.diff(starts))
        inside = np.ones(len(c), bool)  # windows that lie within one token
        inside[starts[1:] - 1] = False
        twos = inside[:-1]
        threes = inside[:-2] & inside[1:-1]
        three, two = places(c)
        for table, at in zip(tables[:TRI], three):
            table += np.bincount(at[threes], weight[:-2][threes], BUCKETS).astype(np.int64)
        for table, at in zip(tables[TRI:], two):
            table += np.bincount(at[twos], weight[:-1][twos], BUCKETS).astype(np.int64)
        first = np.zeros(len(c), bool)
        first[starts[:-1]] = True
        single_characters += np.bincount(c[~first].astype(np.int64), weight[~first], CHARACTERS).astype(np.int64)
    yield from enumerate([*tables, single_characters])


PARTS = "kind int, part int, counts binary"


def summed(tokens: DataFrame) -> list[np.ndarray]:
    """The tables over (token, n). They are added up part by part and reach the driver packed: (tables x parts) rows of
    a fixed size, whatever the corpus."""

    def count(batches):
        parts = ([(p, n) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in INNER.split(t) if p] for b in batches)
        for kind, table in counted(([p for p, _ in x], [n for _, n in x]) for x in parts):
            for part in range(len(table) // PART):
                piece = table[part * PART : (part + 1) * PART]
                if piece.any():
                    yield pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "counts": zlib.compress(piece.tobytes(), 1)}], PACKED)

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.int64)
        for blob in t["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(blob), np.int64)
        return pa.Table.from_pylist(
            [{"kind": t["kind"][0].as_py(), "part": t["part"][0].as_py(), "counts": zlib.compress(total.astype(np.float32).tobytes(), 1)}],
            PACKED,
        )

    rows = tokens.select("token", "n").mapInArrow(count, PARTS).groupBy("kind", "part").applyInArrow(add, PARTS)
    out = [np.zeros(BUCKETS, np.float32) for _ in range(TRI + BI)] + [np.zeros(CHARACTERS, np.float32)]
    for r in rows.collect():
        out[r.kind][r.part * PART : (r.part + 1) * PART] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.float32)
    return out


PACKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


class Model:
    """Character trigrams in tables of fixed size: how likely a word is spelled so."""

    def __init__(self, tables: list[np.ndarray]):
        self.tri, self.bi, self.uni = tables[:TRI], tables[TRI : TRI + BI], tables[TRI + BI]
        self.total = max(1.0, float(self.uni.sum()))
        self.smooth = SMOOTH + SMOOTH_SHARE * self.total
        self.least = max(LEAST_SEEN, LEAST_SHARE * self.total)
        self.seen = frozenset(map(chr, np.flatnonzero(self.uni >= self.least)))

    def known(self, text: str) -> bool:
        """Whether all its characters occur in the corpus."""
        return all(c in self.seen or INNER.match(c) for c in text if c > "\x7f")

    def punctuation(self, word: str, core: str) -> float:
        """Log-likelihood of the characters beyond ASCII around a word's core."""
        at = word.find(core)
        return sum(float(np.log((self.uni[ord(c)] + 0.5) / self.total)) for c in word[:at] + word[at + len(core) :] if c > "\x7f")

    def spelled(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text by its characters."""
        if not texts:
            return np.zeros(0)
        c, starts = padded(texts)
        three, two = places(c)
        t = np.minimum.reduce([table[at] for table, at in zip(self.tri, three)])
        b = np.minimum.reduce([table[at] for table, at in zip(self.bi, two)])
        u = self.uni[c.astype(np.int64)]
        back = (b[1:] + self.smooth * (u[2:] + 0.01) / self.total) / (u[1:-1] + self.smooth)
        logs = np.concatenate([[0.0], np.cumsum(np.log((t + self.smooth * back) / (b[:-1] + self.smooth)), dtype=np.float64)])
        return logs[starts[1:] - 2] - logs[starts[:-1]]


# --- tokens


RECORD = "source string, field string, key long, text string, tokens array<string>"
KEY = ["source", "field", "key"]


def records_of(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """(source, field, key, text): the texts of blocks and, with key -1, the titles of books."""
    b = latest_blocks(blocks, "text").select(F.col("book_id").alias("source"), F.lit("text").alias("field"), F.col("block_id").alias("key"), "text")
    t = books.where("book_id is not null").groupBy("book_id").agg(F.max("title").alias("text"))
    return b.unionByName(t.select(F.col("book_id").alias("source"), F.lit("title").alias("field"), F.lit(-1).cast("long").alias("key"), "text"))


def with_tokens(records: DataFrame) -> DataFrame:
    """The records with their tokens beyond ASCII, in order and as often as they occur."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [[w for w in SPACES.split(opened(t)) if not w.isascii()] if t and not (t.isascii() and "&" not in t) else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], [*batch.schema.names, "tokens"])

    return records.select(*KEY, "text").mapInArrow(run, RECORD)


def token_counts(records: DataFrame) -> DataFrame:
    """(token, n): every distinct token of the corpus and how often it occurs."""

    def run(batches):
        def rows(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(SPACES.split(opened(t)))
            if len(counts) > 200_000:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    counts = records.select("text").mapInArrow(run, "token string, n long")
    return counts.where("token <> ''").groupBy("token").agg(F.sum("n").alias("n"))


READ = "token string, n long, chains array<int>, news array<string>, plain string, lost boolean, sequences boolean, need array<string>"
READ_TYPES = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
READ_NAMES = ["token", "n", "chains", "news", "plain", "lost", "sequences", "need"]


def read_tokens(counts: DataFrame) -> DataFrame:
    """The distinct tokens with what the chains make of them, and the words whose counts are needed to weigh that."""

    def run(batches):
        for batch in batches:
            rows = []
            for token, n in zip(*[c.to_pylist() for c in batch.columns]):
                if token.isascii():
                    rows.append((token, n, [], [], None, False, False, []))
                    continue
                got, lost, sequences = readings(token)
                plain = plain_form(token) if got else token
                need = {w for t in (token, plain, *(new for _, new in got)) for w in words_of(t)} if got else ()
                rows.append((token, n, [k for k, _ in got], [new for _, new in got], None if plain == token else plain, lost, sequences, list(need)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ_TYPES)], READ_NAMES)

    return counts.select("token", "n").mapInArrow(run, READ)


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word, n) over (token, n): of the words of each token, without the punctuation around them, and of itself; a
    token of ASCII is never asked for with its punctuation."""
    parts = F.array_append(F.split("token", INNER.pattern), F.col("token"))
    words = F.transform(parts, lambda w: F.btrim(w, F.lit(AROUND)))
    words = F.array_distinct(F.when(F.col("token").rlike(r"[^\x00-\x7f]"), F.array_append(words, F.col("token"))).otherwise(words))
    return tokens.select("n", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


WEIGHED = "token string, chains array<int>, gains array<double>, news array<string>, lost boolean"


def weighed(candidates: DataFrame, model_of, n_words: float, least: float) -> DataFrame:
    """(token, chains, gains, news, lost) of the tokens that some chain gains more than ``least`` for, or that lost
    characters.

    ``candidates`` carry the counts of their words as arrays ``words`` and ``numbers``."""

    def run(batches):
        model = Model(model_of.value)
        blank = float(np.log(BLANK_SHARE))
        for batch in batches:
            c = batch.to_pydict()
            texts: list[str] = []
            place: dict[str, int] = {}
            kept = []  # (row, chain, old, plain, new)
            for row, (token, chains, news, plain) in enumerate(zip(c["token"], c["chains"], c["news"], c["plain"])):
                for chain, new in zip(chains, news):
                    if model.known(new):
                        for t in (token, plain, new):
                            if t is not None and t not in place:
                                place[t] = len(texts)
                                texts.append(t)
                        kept.append((row, chain, token, plain, new))
            parts = [[p for p in INNER.split(t) if p] for t in texts]
            spelled = model.spelled([p for ps in parts for p in ps])
            ends = np.concatenate([[0], np.cumsum([len(ps) for ps in parts])]).astype(np.int64)
            numbers = [dict(zip(w or (), k or ())) for w, k in zip(c["words"], c["numbers"])]

            def score(row: int, text: str) -> float:
                def of(word: str, otherwise: float) -> float:
                    core = word.strip(AROUND)
                    for w in {word, core}:
                        n = numbers[row].get(w, 0) - 1.0  # a word's own occurrence is left out
                        if n > 0:
                            otherwise = float(np.logaddexp(otherwise, np.log(n / n_words) + (0.0 if w == word else model.punctuation(word, core))))
                    return otherwise

                k = place[text]
                total = sum(of(p, s) for p, s in zip(parts[k], spelled[ends[k] : ends[k + 1]]))
                return of(text, total + blank * len(INNER.findall(text))) if len(parts[k]) != 1 or parts[k][0] != text else total

            found: dict[int, list] = {}
            base: dict[int, float] = {}
            for row, chain, token, plain, new in kept:
                if row not in base:
                    base[row] = max(score(row, token), score(row, plain) if plain is not None else -np.inf)
                gain = score(row, new) - base[row]
                if gain > least:
                    found.setdefault(row, []).append((chain, min(gain, MOST_GAIN) + BEYOND * max(0.0, gain - MOST_GAIN), new))
            rows = [
                (c["token"][r], *map(list, zip(*found[r])), c["lost"][r]) if r in found else (c["token"][r], [], [], [], True) for r in range(batch.num_rows) if r in found or c["lost"][r]
            ]
            if rows:
                types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["token", "chains", "gains", "news", "lost"])

    return candidates.select("token", "chains", "news", "plain", "lost", "words", "numbers").mapInArrow(run, WEIGHED)


def with_numbers(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """The candidates with the counts (word, n) of the words they need."""
    need = candidates.select("token", F.explode("need").alias("word"))
    per = need.join(counts, "word").groupBy("token").agg(F.collect_list(F.struct("word", "n")).alias("c"))
    return candidates.join(per, "token", "left").select(*[c for c in READ_NAMES], F.col("c.word").alias("words"), F.col("c.n").alias("numbers"))


# --- records


def evidence(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, field, key, lost, ev): the records that have evidence or lost characters; ``ev`` has a chain's gain over
    the whole record."""
    counts = F.filter(F.arrays_zip("chains", "gains"), lambda z: z["gains"] > WORD_GAIN)
    strong = weights.select("token", counts.alias("z"), "lost").where("lost or size(z) > 0")
    hits = tokens.join(small_side(strong), "token")
    by_chain = hits.select(*KEY, "lost", F.explode_outer("z").alias("z"))
    sums = by_chain.groupBy(*KEY, F.col("z.chains").alias("chain")).agg(F.sum("z.gains").alias("gain"), F.max("lost").alias("lost"))
    pair = F.when(F.col("chain").isNotNull(), F.struct("chain", "gain"))
    return sums.groupBy(*KEY).agg(F.max("lost").alias("lost"), F.collect_list(pair).alias("ev"))


def posteriors(suspects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, field, key, lost, chain, posterior): the likeliest chain of each suspect (null: clean, or only lost) and
    the posterior of being garbled, after ROUNDS of expectation-maximization.

    The M step's sums are a row per source and field, and a value per field and chain; the E step is an expression over
    a record's array."""
    totals = {r["field"]: r["n"] for r in sizes.groupBy("field").agg(F.sum("n").alias("n")).collect()}
    share = {f: [0.2 / len(CHAINS)] * len(CHAINS) for f in totals}
    local = None
    # likelihoods are relative to the greatest one, or to that of being clean, so that no exponential overflows
    top = F.greatest(F.coalesce(F.array_max(F.transform("ev", lambda e: e["gain"])), F.lit(0.0)), F.lit(0.0))
    now = suspects.join(sizes, ["source", "field"]).withColumn("top", top).withColumn(
        "ev",
        F.transform("ev", lambda e: F.struct(e["chain"].alias("chain"), e["gain"].alias("gain"), F.lit(0.0).alias("p"))),
    )
    for _ in range(ROUNDS):
        if not share:
            break
        prior_of = F.try_element_at(F.create_map(*[x for f, v in share.items() for x in (F.lit(f), F.array(*map(F.lit, v)))]), F.col("field"))
        rows = now.withColumn("own", F.lit(None).cast("map<int,double>")) if local is None else now.join(local, ["source", "field"], "left")

        def odds(e):
            # a record's own part in the count of its source is left out, or it would confirm itself
            own = F.coalesce(F.try_element_at(F.col("own"), e["chain"]), F.lit(0.0))
            prior = (FIELD_WEIGHT * F.get(F.col("prior"), e["chain"]) + F.greatest(F.lit(0.0), own - e["p"])) / (FIELD_WEIGHT + F.col("n") - 1)
            return F.struct(e["chain"].alias("chain"), e["gain"].alias("gain"), (prior * F.exp(e["gain"] - F.col("top"))).alias("p"))

        rows = rows.withColumn("prior", prior_of).withColumn("ev", F.transform("ev", odds)).withColumn(
            "all",
            F.aggregate("ev", F.exp(-F.col("top")), lambda s, e: s + e["p"]),
        )
        now = cut(
            rows.withColumn(
                "ev",
                F.transform("ev", lambda e: F.struct(e["chain"].alias("chain"), e["gain"].alias("gain"), (e["p"] / F.col("all")).alias("p"))),
            ).drop("own", "all", "prior"),
        )
        flat = now.select("source", "field", F.explode("ev").alias("e")).groupBy("source", "field", F.col("e.chain").alias("chain")).agg(F.sum("e.p").alias("p"))
        local = flat.groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "p"))).alias("own"))
        sums = {(r["field"], r["chain"]): r["s"] for r in flat.groupBy("field", "chain").agg(F.sum("p").alias("s")).collect()}
        share = {f: [(sums.get((f, k), 0.0) + 0.02) / (totals[f] + 1) for k in range(len(CHAINS))] for f in totals}
    best = F.array_max(F.transform("ev", lambda e: F.struct(e["p"].alias("p"), e["chain"].alias("chain"))))
    garbled = F.aggregate("ev", F.lit(0.0), lambda s, e: s + e["p"])
    rows = now.select(*KEY, "lost", garbled.alias("posterior"), best["chain"].alias("chain"))
    return rows.withColumn("chain", F.when(F.col("posterior") > 0.5, F.col("chain")))


def changes(tokens: DataFrame, weights: DataFrame, found: DataFrame) -> DataFrame:
    """(source, field, key, token, new): the tokens that the records' chains change."""
    of = found.where("chain is not null").select(*KEY, "chain")
    news = small_side(weights.select("token", F.map_from_arrays("chains", "news").alias("by_chain")))
    rows = tokens.join(of, KEY).join(news, "token")
    return rows.select(*KEY, "token", F.try_element_at("by_chain", F.col("chain")).alias("new")).where("new is not null")


def detect(records: DataFrame, repair: bool = True) -> DataFrame:
    """(source, field, key, chain, posterior) of the garbled records; with ``repair``, text and restored as well.

    Tokens with sequences that only a wrong encoding makes do not teach the model. Other garbled text does at first;
    once it is known, its tokens are taken from the counts, their repaired forms are added, and the suspects are weighed
    again."""
    spark = records.sparkSession
    records = stored(with_tokens(records), "records")
    tokens = stored(read_tokens(token_counts(records)), "tokens")
    plain = tokens.where("not lost and not sequences").select("token", "n")
    tables = summed(plain)
    counts = word_counts(plain)
    candidates = tokens.where("size(chains) > 0 or lost")
    needed = cut(
        candidates.select(F.explode("need").alias("word")).distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n")),
    )
    n_words = float(plain.agg(F.sum("n")).head()[0] or 1)

    def weights_of(tables: list[np.ndarray], numbers: DataFrame, among: DataFrame, least: float) -> DataFrame:
        shared = checked_broadcast(spark, tables, sum(t.nbytes for t in tables))
        got = stored(weighed(with_numbers(among, numbers), shared, n_words, least), "weights")
        shared.destroy()
        return got

    weights = weights_of(tables, needed, candidates, WORD_GAIN)
    every = records.select(*KEY, F.explode("tokens").alias("token"))
    sizes = cut(records.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n")))
    suspects = cut(evidence(every, weights))
    theirs = stored(records.join(suspects.select(*KEY), KEY, "left_semi").select(*KEY, F.explode("tokens").alias("token")), "suspects")
    found = cut(posteriors(suspects, sizes))
    among = candidates.join(small_side(theirs.select("token").distinct()), "token", "left_semi") if CLEANINGS else None
    for _ in range(CLEANINGS):
        moved = cut(changes(theirs, weights, found).groupBy("token", "new").agg(F.count(F.lit(1)).alias("n")))
        # tokens that were never counted are not taken away
        away = moved.join(plain.select("token").alias("c"), "token", "left_semi").select("token", (-F.col("n")).alias("n"))
        delta = away.unionByName(moved.select(F.col("new").alias("token"), "n"))
        changed = [np.maximum(t + d, 0) for t, d in zip(tables, summed(delta))]
        numbers = needed.unionByName(word_counts(delta)).groupBy("word").agg(F.sum("n").alias("n"))
        weights = weights_of(changed, numbers, among, REPAIR_GAIN)
        found = cut(posteriors(evidence(theirs, weights), sizes))
    found = found.where("lost or chain is not null")
    names = F.when(F.col("chain").isNotNull(), F.get(F.array(*map(F.lit, NAMES)), F.col("chain")))
    rows = found.select(
        *KEY,
        F.coalesce(names, F.lit(LOST)).alias("chain"),
        F.when(F.col("chain").isNull(), 1.0).otherwise(F.col("posterior")).alias("posterior"),
    )
    if not repair:
        return rows
    news = changes(theirs, weights, found).groupBy(*KEY).agg(F.collect_set(F.struct("token", "new")).alias("news"))
    whole = rows.join(records.select(*KEY, "text"), KEY).join(news, KEY, "left")
    return whole.mapInArrow(mend, "source string, field string, key long, chain string, posterior double, text string, restored string")


def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        restored = []
        for text, news in zip(batch.column("text").to_pylist(), batch.column("news").to_pylist()):
            new = repaired(text, {x["token"]: x["new"] for x in news}) if news else text
            restored.append(None if new == text else new)
        names = [*KEY, "chain", "posterior", "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], pa.array(restored, pa.string())], [*names, "restored"])


def repaired(text: str, news: dict[str, str]) -> str:
    """The text with tokens replaced, in which all else stays as it is."""
    out, at = [], 0
    for m in [*SPACES.finditer(text), None]:
        raw = text[at : m.start() if m else len(text)]
        word = opened(raw)
        out += [closed(raw, news[word]) if word in news else raw, m.group() if m else ""]
        at = m.end() if m else at
    return "".join(out)
