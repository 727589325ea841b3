"""Problem 6: corpus encoding with a public byte-level BPE.

Per partition, an embedded DuckDB holds the merge table. The distinct words of a stretch of documents become
token-position rows; a recursive query joins adjacent rows with the merge table and contracts, in every word, the
pair of least rank, from the left and without overlap, until no pair is left. Merging every occurrence of that pair
in one step equals merging them one after the other, as a token arises from one merge only and every pair with it
ranks later; this keeps long runs (rules, blanks, base64) from needing one step per token.

Defined results: null and empty texts give an empty list; of rows with one doc_id the greatest text counts; rows
without doc_id are left out. Strings that spell special tokens are ordinary text.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.session import checked_broadcast, spread

TOKENIZER_DIR = "/opt/tokenizers"

#: The published pre-tokenisation pattern of this family of byte-level BPE vocabularies.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points gathered before the recursive query runs once over their new words.
STRETCH_CHARS = 1_500_000
#: Words remembered by a task between stretches; the memory is emptied when full.
CACHE_WORDS = 200_000

CONTRACT = """
WITH RECURSIVE step(w, pos, tok, done) AS (
    SELECT w, pos, tok, false FROM start
  UNION ALL
    SELECT w, pos, CASE WHEN hit THEN merged ELSE tok END, NOT busy
    FROM (
        SELECT w, pos, tok, merged, hit, busy, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS eaten
        FROM (
            SELECT *, least_rank AND (n - coalesce(max(CASE WHEN NOT least_rank THEN n END) OVER (
                PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS hit
            FROM (
                SELECT a.w, a.pos, a.tok, a.n, m.merged,
                    coalesce(m.rank = min(m.rank) OVER (PARTITION BY a.w), false) AS least_rank,
                    count(m.rank) OVER (PARTITION BY a.w) > 0 AS busy
                FROM (
                    SELECT w, pos, tok, row_number() OVER (PARTITION BY w ORDER BY pos) AS n,
                        lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt
                    FROM step WHERE NOT done
                ) a LEFT JOIN merges m ON a.tok = m.l AND a.nxt = m.r
            )
        )
    )
    WHERE NOT eaten
)
SELECT w, list(tok ORDER BY pos) AS toks FROM step WHERE done GROUP BY w ORDER BY w
"""

DECODE = """
SELECT d, string_agg(piece, '' ORDER BY pos) AS hexes
FROM (SELECT d, pos, tok FROM ids) JOIN pieces USING (tok) GROUP BY d ORDER BY d
"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_model(path: str) -> dict:
    """Arrays of a vocabulary file: merges as ids in rank order, ids of single bytes, bytes of each id."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, alphabet = model["vocab"], byte_alphabet()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32)
    first = np.zeros(256, dtype=np.int32)
    for ch, b in alphabet.items():
        first[b] = vocab[ch]
    pieces = {i: bytes(alphabet[c] for c in t).hex() for t, i in vocab.items() if all(c in alphabet for c in t)}
    return {"merges": merges, "bytes": first, "pieces": pieces}


def connect(model: dict):
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    m = model["merges"]
    given = pa.table({"l": m[:, 0], "r": m[:, 1], "merged": m[:, 2], "rank": np.arange(len(m), dtype=np.int32)})
    db.register("given", given)
    db.execute("CREATE TABLE merges AS SELECT * FROM given")
    db.unregister("given")
    return db


def contract(db, model: dict, words: list[bytes]) -> list[list[int]]:
    """Token ids of each word by the recursive query."""
    if not words:
        return []
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    w = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    start = pa.table({"w": w, "pos": np.arange(len(raw), dtype=np.int32), "tok": model["bytes"][raw]})
    db.register("start", start)
    try:
        return db.sql(CONTRACT).to_arrow_table().column("toks").to_pylist()
    finally:
        db.unregister("start")


class Encoder:
    """Encodes lists of texts; one per task."""

    def __init__(self, model: dict, pattern: str = WORD_PATTERN):
        import regex

        self.model, self.find, self.db = model, regex.compile(pattern).findall, connect(model)
        self.seen: dict[str, list[int]] = {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in self.seen))
        if len(self.seen) + len(fresh) > CACHE_WORDS:
            self.seen = {}
            fresh = list(dict.fromkeys(w for ws in split for w in ws))
        self.seen.update(zip(fresh, contract(self.db, self.model, [w.encode("utf-8", "replace") for w in fresh])))
        seen = self.seen
        return [[i for w in ws for i in seen[w]] for ws in split]


def one_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id."""
    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))


def encode_corpus(
    documents: DataFrame,
    tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json",
    pattern: str = WORD_PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids) for every document."""
    spark = documents.sparkSession
    model = load_model(tokenizer)
    shared = checked_broadcast(spark, model, len(pickle.dumps(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value, pattern)
        for ids, texts in stretches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return one_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about STRETCH_CHARS code points; a text is never cut."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 0
            if size >= STRETCH_CHARS or len(ids) >= 20_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def decode_corpus(encoded: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by an ordered aggregation; an empty list gives the empty text."""
    model = load_model(tokenizer)
    shared = checked_broadcast(encoded.sparkSession, model, len(pickle.dumps(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        pieces = shared.value["pieces"]
        given = pa.table({"tok": pa.array(list(pieces), pa.int32()), "piece": pa.array(list(pieces.values()))})
        db.register("given", given)
        db.execute("CREATE TABLE pieces AS SELECT * FROM given")
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = part.column(1)
                lens = np.array([len(x or ()) for x in ids.to_pylist()], dtype=np.int64)
                flat = ids.flatten()
                rows = pa.table(
                    {"d": np.repeat(np.arange(len(lens), dtype=np.int32), lens), "pos": np.arange(len(flat), dtype=np.int32), "tok": flat},
                )
                db.register("ids", rows)
                got = db.sql(DECODE).to_arrow_table().to_pydict()
                texts = [""] * len(lens)
                for d, h in zip(got["d"], got["hexes"]):
                    texts[d] = bytes.fromhex(h).decode("utf-8", "replace")
                db.unregister("ids")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
