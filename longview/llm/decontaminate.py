"""Benchmark decontamination by template canonicalisation.

Words are lower-cased without punctuation; numbers, names (capitalised inside a sentence) and units
(after a number) become typed placeholders. Windows of ``WINDOW`` such tokens of a document are joined by their hash
with those of the benchmark. A window counts if its plain words are the item's and its slots are
consistent: equal values of the item stand for equal values in the document. So a question with other
numbers or names is caught, and a chance likeness is not. Different values may become equal. Windows are judged one by
one, so a conflict elsewhere in a passage does not hide them. A window of fewer than ``LITERALS`` plain words, such as
a row of a table of numbers, is no template and is left out.

Windows of the plain lower-cased words, without placeholders, are joined too, and count whatever they
are made of: so a copy of numbers and names is found, and one in other capitals.

Nothing is held by the driver but a bit table of fixed size, by which documents send only windows that some item
may have, with their few words, to the join. The items' windows are a written table, broadcast by Spark where its size
allows it. What is found is kept for each different text (by 128 bits of hash) and looked up by it.

Defined cases: null and empty texts match nothing; items with 4 to 7 tokens are matched whole, shorter
ones never; a null item id is reported as null; repeated items and documents each count; an empty
benchmark or table matches nothing; further columns are kept, but for those named as the two results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .common import BROADCAST_KEYS, is_small, lookup, settle, small_batches

WINDOW = 8
SHORTEST = 4
LITERALS = 4
#: Of the table of bits: 16 MB.
BITS = 27
NUMBER, NAME, UNIT = 1, 2, 3
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years decade decades c f k celsius fahrenheit kelvin degree degrees percent dollar dollars euro euros cent cents usd eur gbp mph kmh w kw kwh v volt volts amp amps watt watts joule joules hz khz mhz ghz b kb mb gb tb byte bytes bit bits".split()

_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_WORD = np.where(_PUNCT, np.uint64(0), arrays.TABLE[arrays.LOWER])
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


class Tokens:
    """The canonical tokens of a batch of texts: hash, hash of the word itself, kind, text number, and where the word stands."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        hashes, words, kinds, docs, starts, stops = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int8, np.int64, np.int64, np.int64))
        seen = np.zeros(len(texts), dtype=np.int64)  # bytes of each text in the pieces before
        with np.errstate(over="ignore"):
            for buf, of, at in arrays.pieces(texts):
                a, b = arrays.spans(buf)
                solid = np.append(np.flatnonzero(~_PUNCT[buf]), len(buf))
                first = solid[np.searchsorted(solid, a)]
                real = first < b
                part = np.searchsorted(at, a, "right") - 1
                new = np.append(True, part[1:] != part[:-1])
                after = np.concatenate(([True], _STOP[buf[b[:-1] - 1]]))
                line = np.concatenate(([0], np.cumsum(buf == 10)))
                after |= np.append(True, line[a[1:]] > line[b[:-1]]) | new
                lead = buf[first.clip(max=len(buf) - 1)]
                upper = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (buf[(first + 1).clip(max=len(buf) - 1)] <= 0x9E)
                h = arrays.span_hash(arrays.sums(_WORD[buf]), first.clip(max=len(buf)), np.maximum(b, first.clip(max=len(buf))))
                kind = np.where(_DIGIT[lead], NUMBER, np.where(upper & ~after, NAME, 0)).astype(np.int8)
                a, b, h, kind, part = (x[real] for x in (first, b, h, kind, part))
                unit = np.isin(h, UNIT_HASHES) & np.append(False, (kind[:-1] == NUMBER) & (part[1:] == part[:-1]))
                kind[unit] = UNIT
                hashes.append(np.where(kind > 0, arrays.TABLE[kind], h))
                words.append(h)
                kinds.append(kind)
                docs.append(of[part])
                shift = seen[of[part]] - at[part]
                starts.append(a + shift)
                stops.append(b + shift)
                np.add.at(seen, of, np.diff(np.append(at, len(buf))) - 1)
        self.hash, self.plain, self.kind, self.doc, self.start, self.stop = map(np.concatenate, (hashes, words, kinds, docs, starts, stops))

    def word(self, i: int) -> bytes:
        text = self.texts[self.doc[i]][self.start[i] : self.stop[i]]
        return bytes(c for c in text.lower() if not _PUNCT[c])


def _unit_hashes() -> np.ndarray:
    with np.errstate(over="ignore"):
        buf = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        a, b = arrays.spans(buf)
        return arrays.span_hash(arrays.sums(_WORD[buf]), a, b)


UNIT_HASHES = _unit_hashes()


class Windows:
    """The windows of some texts that may count: text number, size, kind (0 template, 1 plain words), hash, first token.

    Of a template window those count that have a slot and ``LITERALS`` plain words; one without slots is a plain one.
    ``use`` says of windows (their texts' numbers of tokens, size, hashes) which are wanted."""

    def __init__(self, texts: list[bytes], sizes, use):
        self.tokens = t = Tokens(texts)
        long = np.bincount(t.doc, minlength=len(texts))
        slots = np.concatenate(([0], np.cumsum(t.kind > 0)))
        parts = [[np.zeros(0, x)] for x in (np.int64, np.int64, np.int64, np.uint64, np.int64)]
        for k in sizes:
            for kind, hashes in enumerate((t.hash, t.plain)):
                h, doc, at = arrays.windows(hashes, t.doc, k)
                with np.errstate(over="ignore"):
                    h = arrays.mix(h + np.uint64(2 * k + kind))
                want = use(long[doc], k, h)
                if kind == 0:
                    n = slots[at + k] - slots[at]
                    want &= (n > 0) & (k - n >= LITERALS)
                want = np.flatnonzero(want)
                for x, y in zip(parts, (doc[want], np.full(len(want), k), np.full(len(want), kind), h[want], at[want])):
                    x.append(y)
        self.doc, self.size, self.kind, self.hash, self.at = map(np.concatenate, parts)
        self.first = np.searchsorted(t.doc, np.arange(len(texts)))

    def columns(self) -> list[pa.Array]:
        """hash, size, kind, first token in its text, words and kinds of tokens of the windows."""
        t = self.tokens
        words, kinds = [], []
        for a, k in zip(self.at.tolist(), self.size.tolist()):
            words.append(b"\0".join(t.word(j) for j in range(a, a + k)))
            kinds.append(t.kind[a : a + k].tobytes())
        at = self.at - self.first[self.doc]
        return [pa.array(self.hash.view(np.int64)), pa.array(self.size), pa.array(self.kind), pa.array(at), pa.array(words, pa.binary()), pa.array(kinds, pa.binary())]


_WINDOW = "h long, size long, kind long, at long, words binary, kinds binary"


def consistent(words: bytes, kinds: bytes, item_words: bytes, item_kinds: bytes) -> bool:
    """Whether a template window's plain words are the item's, and equal values of the item's slots stand for equal ones."""
    stands: dict[tuple[int, bytes], bytes] = {}
    for x, a, y, b in zip(words.split(b"\0"), kinds, item_words.split(b"\0"), item_kinds):
        if a != b or (stands.setdefault((b, y), x) if b else y) != x:
            return False
    return True


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of all items, with item (number of its row) and item_id: of ``WINDOW`` tokens, or whole shorter items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrays.small(batches, 2):
            w = Windows(arrays.as_bytes(b.column(2)), range(SHORTEST, WINDOW + 1), lambda n, k, h: (n == k) if k < WINDOW else (n >= k))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(w.doc)), b.column(1).take(pa.array(w.doc)), *w.columns()], names)

    names = ["item", "item_id", "h", "size", "kind", "item_at", "item_words", "item_kinds"]
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return settle(rows.mapInArrow(run, "item long, item_id long, h long, size long, kind long, item_at long, item_words binary, item_kinds binary"), "items")


def _filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each value of the leading ``BITS`` bits of the windows' hashes, and the sizes of windows.

    Its size is fixed; it only spares the windows of documents that no item has the way to the join."""
    spare, pieces = BITS - 3, 16

    def bits(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        part = np.zeros((1 << spare) // pieces, np.uint8)
        at = (h >> np.uint64(3)).astype(np.int64) % len(part)
        np.bitwise_or.at(part, at, np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([part.tobytes()], pa.binary())})

    piece = F.shiftrightunsigned("h", 60)
    got = items.select(piece.alias("piece"), "h").distinct().groupBy("piece").applyInArrow(bits, "piece long, bits binary").collect()  # 16 rows of fixed size
    mask = np.zeros((pieces, (1 << spare) // pieces), np.uint8)
    for r in got:
        mask[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return mask.ravel(), sorted(r[0] for r in items.select("size").distinct().collect())  # five sizes at most


def _key(text: str):
    return [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]


def found(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """__k1 and __k2 (which stand for a text), item_ids and n_matched of the texts with a match."""
    spark = docs.sparkSession
    items = item_windows(benchmark)
    mask, sizes = _filter(items)
    shared = spark.sparkContext.broadcast(mask)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value

        def known(n: np.ndarray, k: int, h: np.ndarray) -> np.ndarray:
            h = h >> np.uint64(64 - BITS)
            return (mask[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & np.uint8(1)) > 0

        for b in arrays.small(batches, 2):
            w = Windows(arrays.as_bytes(b.column(2)), sizes, known)
            of = pa.array(w.doc)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *w.columns()], ["__k1", "__k2", *(x.split()[0] for x in _WINDOW.split(", "))])

    near = docs.select(*_key(text), F.col(text).alias("text")).mapInArrow(candidates, f"__k1 long, __k2 long, {_WINDOW}")
    near = settle(near, "windows")  # else each task of a broadcast join would need two Python workers
    # Joined by hash: the items' windows are broadcast by Spark where their size allows it.
    met = near.join(items, ["h", "size", "kind"]).select("__k1", "__k2", "at", "size", "kind", "words", "kinds", "item_words", "item_kinds", "item", "item_id")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, *sides = (b.column(k).to_pylist() for k in (4, 5, 6, 7, 8))
            good = [x == y if k else consistent(x, a, y, c) for k, x, a, y, c in zip(kind, *sides)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 3, 9, 10)], ["__k1", "__k2", "at", "size", "item", "item_id"]).filter(pa.array(good, pa.bool_()))

    hits = settle(met.mapInArrow(judge, "__k1 long, __k2 long, at long, size long, item long, item_id long"), "hits")
    keys = ["__k1", "__k2"]
    ids = hits.select(*keys, "item", "item_id").distinct().groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "item_id"))), lambda x: x["item_id"]).alias("item_ids"))
    covered = hits.select(*keys, F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("token")).distinct().groupBy(*keys).agg(F.count("*").alias("n_matched"))
    return settle(ids.join(covered, keys), "found")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with item_ids (array of long, an id for each matching row of the benchmark) and n_matched (long, the
    document's tokens in matching windows)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("item_ids", "n_matched")
    out = lookup(docs.select("*", *_key(text)), found(docs, benchmark, text), ["__k1", "__k2"], text)
    return out.select(*docs.columns, F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n_matched", F.lit(0).cast("long")).alias("n_matched"))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark item, with all their columns."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *_key("text"))
    gone = found(docs, benchmark).select("__k1", "__k2")
    return rows.join(F.broadcast(gone) if is_small(gone, BROADCAST_KEYS) else gone, ["__k1", "__k2"], "left_anti").select("__row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", *_key("text"))  # the texts themselves are read for the windows only
    out = lookup(rows, found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), ["__k1", "__k2"], "doc_id")
    n = F.coalesce(F.size("item_ids"), F.lit(0)).cast("long")
    text = F.coalesce(F.array_join(F.col("item_ids").cast("array<string>"), ","), F.lit(""))
    return out.select("doc_id", (F.coalesce(F.size("item_ids"), F.lit(0)) > 0).alias("contaminated"), n.alias("n_items"), F.coalesce("n_matched", F.lit(0).cast("long")).alias("n_matched"), text.alias("item_ids"))
