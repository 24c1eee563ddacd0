"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A batch's new pre-tokens are held as one flat numpy array of symbols with their sequence numbers. In
each round every sequence's lowest-rank pair is looked up, all its occurrences in that sequence are
merged at once (left to right where they overlap), and sequences without a pair are done: the symbols
that survive are their tokens. Counts of pre-tokens are kept for later batches in a table of bounded
size; it only saves time.

Documents stay where they are: no shuffle. A worker's memory is bounded by a batch, a long text being
split into pre-tokens of its own, and by ``CACHE`` entries.

Defined cases: null and empty texts have 0 tokens; added special tokens inside a text count as one
token; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

CACHE = 400_000
#: The public pre-tokenization pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1) << 40


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}


class Merger:
    """Merge ranks as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        chars = byte_alphabet()
        self.of_byte = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = np.zeros(len(words), dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(words)), lengths)
        while symbols.size > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.rank[at], _NONE)
            rank = np.append(rank, _NONE)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(seq))))
            done = least == _NONE
            merge = (rank == least) & ~done
            # Occurrences that overlap follow one another: every other one of such a run is merged.
            where = np.flatnonzero(merge)
            starts = np.append(True, np.diff(where) != 1) if where.size else np.zeros(0, bool)
            run_start = np.maximum.accumulate(np.where(starts, np.arange(where.size), 0))
            where = where[(np.arange(where.size) - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.made[at[where]]
            keep = ~done
            keep[where + 1] = False
            out += np.bincount(seq[done], minlength=len(words))
            symbols, seq = symbols[keep], seq[keep]
        return out + np.bincount(seq, minlength=len(words))


def check_supported(spec: dict) -> None:
    """Raise unless a tokenizers file is plain byte-level BPE, as the counter takes it to be."""
    plain = {"continuing_subword_prefix": "", "end_of_word_suffix": "", "byte_fallback": False, "ignore_merges": False, "dropout": 0}
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k, v in plain.items() if (model.get(k) or v) != v]
    wrong += ["model"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * (spec.get("normalizer") is not None)
    wrong += ["pre_tokenizer"] * (before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True))
    wrong += ["added_tokens"] * any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if wrong:
        raise ValueError(f"only byte-level BPE without normalizer is supported; the file differs in: {', '.join(wrong)}")


class Counter:
    """Counts the tokens of texts for a tokenizers JSON file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merger = Merger(spec["model"]["vocab"], merges)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens, and how many special tokens it has."""
        if self.special is None or not (marks := self.special.findall(text)):
            return self.find(text), 0
        return [x for part in self.special.split(text) for x in self.find(part)], len(marks)

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.pieces(t) if t else ([], 0) for t in texts]
        new = [*set().union(*(p for p, _ in split)).difference(self.known)]
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = [*set().union(*(p for p, _ in split))]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, self.merger.count([w.encode() for w in part]).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, p)) + n for p, n in split]


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n: list[int] = []
            part: list[str | None] = []
            size = 0
            for t in texts:  # a few MB of text at a time
                part.append(t)
                size += len(t or "")
                if size > 4_000_000:
                    n += count.counts(part)
                    part, size = [], 0
            n += count.counts(part)
            sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
