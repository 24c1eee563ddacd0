"""Scoring texts with a weighted backoff automaton learned from the corpus.

Words and one end are tokens; lower-cased word hashes of 64 bits stand for words. The states are the n-grams seen in
training: every pair of tokens (u, v), every word v, the begin of a text, and the root, whatever the size of the
corpus. With c for counts, N for all tokens, V for distinct ones:

* the root's arc for w weighs P(w) = (c(w) + 1) / (N + V + 1), all unknown words sharing one type;
* v's arc for w weighs P(w | v) = (c(vw) + BIGRAM * P(w)) / (c(v) + BIGRAM); where vw is unseen that is the failure arc to
  the root, BIGRAM / (c(v) + BIGRAM), and the root's arc;
* (u, v)'s arc for w weighs (c(uvw) + TRIGRAM * P(w | v)) / (c(uv) + TRIGRAM); where uvw is unseen that is the failure
  arc to v, TRIGRAM / (c(uv) + TRIGRAM), and what follows from there; an unseen uv is at v at once.

So each state has one distribution. A text is walked once from left to right, and the logarithms are added up.

A logarithm is a numerator's, c(uvw) + TRIGRAM * P(w | v), less a denominator's, c(uv) + TRIGRAM. The pair (v, w) knows what its
token's numerator needs and the next token's denominator. So each token is one event, and all events of a pair meet in
one task, which counts c(vw) and c(uvw) from those of training rows. Where that is depends on counts, the weights do not:

1. Words of the training rows are counted, combined by block before the shuffle. The ``SHARED`` most frequent are in a
   broadcast table with their counts. Other words are cold: the task of a cold word's hash knows its count, and gets the
   pairs with it; a pair of two cold words goes to the first one's task, and on to the second's with c(v).
2. Pairs and triples that are hot (about one in ``HOT`` tokens or more, so ``HOT`` of either at most) are found from each
   task's most frequent ones, and then counted exactly in a pass of their own. A hot triple, and the denominator after
   a hot pair, are weighed where the text is; a hot pair's other triples go to tasks by (u, v, w). So no task gets a
   large share of the events.
3. Blocks send the events of a task packed, with steps between the numbers of their rows. Sums are added by row.

Defined cases: null and empty texts have one token, the end; a null id counts as empty text for the split;
repeated rows are scored alike; without training rows every token is unknown; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .common import settle, small_batches

#: The most words in the broadcast table; it does not change a score.
SHARED = 1 << 18
BIGRAM = 300.0
TRIGRAM = 5.0
BLOCK = 1_000_000
#: Parts of the pairs of shared words in a task, which it takes one by one.
SLICES = 8
#: The n-grams of either order that a task keeps counts of while it looks for hot ones.
HELD = 1 << 18
HOT = 8192
END = np.uint64(0x5D1F0C2B9A7E4413)
#: Marks the hash of a cold word where numbers of shared ones stand as well.
_COLD = np.uint64(1 << 63)
_TOP = np.uint32(1 << 31)
#: Kinds of events: the second word of a pair is cold; the first; both; a hot pair. Then what tasks send on:
#: pairs of two cold words with c(v); sums; and the rows themselves. The last are pairs of shared words, by slice.
SECOND, FIRST, BOTH, HOT_PAIR, ONWARD, SUMS, ROWS, PAIR = range(8)

_COUNTS = "bucket int, hashes binary, counts binary, n long, v long"
_EVENTS = "bucket int, kind byte, rows binary, step binary, a binary, b binary, u binary"
_EVENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), *((c, pa.binary()) for c in ("rows", "step", "a", "b", "u"))])


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)]):
        yield int(key[order[a]]), order[a:b]


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h[first], np.add.reduceat(c, first) if len(first) else c[:0]


def _cat(column, t) -> np.ndarray:
    return np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in column.to_pylist())])


def _among(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``x`` would be in the sorted ``table``, and whether it is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all tokens, each text's end included."""
    h, d = arrays.word_hashes(texts)
    h[h == END] = END + np.uint64(1)
    at = np.cumsum(np.bincount(d, minlength=len(texts)))
    return np.insert(h, at, END), np.insert(d, at, np.arange(len(texts)))


def counts(train: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket of word hashes: packed hashes and counts, their sum and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, held = [], [], 0

        def flush():
            h, c = _summed(np.concatenate(hs), np.concatenate(cs))
            rows = [{"bucket": b, "hashes": h[at].tobytes(), "counts": c[at].tobytes(), "n": 0, "v": 0} for b, at in _split((h % np.uint64(buckets)).astype(np.int64))]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for b in arrays.small(batches, 0):
            h, c = np.unique(tokens(arrays.as_bytes(b.column(0)))[0], return_counts=True)
            hs.append(h)
            cs.append(c.astype(np.int64))
            held += len(h)
            if held >= BLOCK:
                h, c = _summed(np.concatenate(hs), np.concatenate(cs))
                hs, cs, held = [h], [c], len(h)
                if held >= BLOCK // 2:
                    yield flush()
                    hs, cs, held = [], [], 0
        if held:
            yield flush()

    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])

    def add(table: pa.Table) -> pa.Table:
        h, c = _summed(_cat(table["hashes"], np.uint64), _cat(table["counts"], np.int64))
        return pa.Table.from_pylist([{"bucket": table["bucket"][0].as_py(), "hashes": h.tobytes(), "counts": c.tobytes(), "n": int(c.sum()), "v": len(h)}], schema=schema)

    return settle(train.select("text").mapInArrow(run, _COUNTS).groupBy("bucket").applyInArrow(add, _COUNTS), "counts")


def _lower(c: np.ndarray) -> np.ndarray:
    """Counts rounded down to four leading bits, so that there are few different ones."""
    e = np.maximum(np.frexp(c.astype(np.float64))[1] - 4, 0)
    return c >> e << e


def frequent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the most frequent words, ``SHARED`` at most, down to the least rounded count that allows it."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                low, n = np.unique(_lower(np.frombuffer(c, np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(n.astype(np.int64))], ["low", "n"])

    found = vocabulary.select("counts").mapInArrow(sizes, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).collect()  # some 500 rows at most
    least, held = np.iinfo(np.int64).max, 0
    for r in sorted(found, reverse=True):
        held += r["n"]
        if held > SHARED:
            break
        least = r["low"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                use = (c >= least) | (h == END)
                yield pa.RecordBatch.from_arrays([pa.array([h[use].tobytes()], pa.binary()), pa.array([c[use].tobytes()], pa.binary())], ["h", "c"])

    rows = vocabulary.select("hashes", "counts").mapInArrow(pick, "h binary, c binary").collect()  # SHARED words and the end at most
    h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["h"], np.uint64) for r in rows)])
    return h, np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["c"], np.int64) for r in rows)])


class States:
    """The shared words and the end, numbered, with their counts, and the numbers of the whole corpus."""

    def __init__(self, hashes: np.ndarray, count: np.ndarray, n: int, v: int):
        if END not in hashes:
            hashes, count = np.append(hashes, END), np.append(count, 0)
        order = np.argsort(hashes)
        self.hashes, self.n, self.v = hashes[order], n, v
        self.size = len(hashes) + 1
        self.end, self.begin, self.none = int(np.searchsorted(self.hashes, END)), self.size - 1, self.size
        self.count = np.append(count[order], 0).astype(np.float64)
        self.prob = self.p1(self.count)
        self.history = self.count + BIGRAM
        self.history[self.begin] = self.count[self.end] + BIGRAM  # every text begins and ends

    def of(self, h: np.ndarray) -> np.ndarray:
        """The number of each token's state, -1 of a cold word."""
        at, there = _among(self.hashes, h)
        return np.where(there, at, -1)

    def p1(self, c: np.ndarray) -> np.ndarray:
        return (c + 1) / (self.n + self.v + 1)


def p2(c: np.ndarray, p1: np.ndarray, history: np.ndarray) -> np.ndarray:
    """P(w | v) of pairs seen ``c`` times; ``history`` is c(v) + BIGRAM."""
    return (c + BIGRAM * p1) / history


class Walk:
    """The tokens of some texts from left to right: hash, text number, state, and of the two tokens before
    the state and hash of the last and the code of the one before it (a state, or a marked hash)."""

    def __init__(self, s: States, texts: list[bytes]):
        self.h, self.d = tokens(texts)
        n = len(self.h)
        self.state = s.of(self.h)
        start = np.append(True, self.d[1:] != self.d[:-1])[:n]
        self.v = np.where(start, s.begin, np.append(0, self.state[:-1])[:n])
        self.v_hash = np.append(np.uint64(0), self.h[:-1])[:n]
        own = np.where(self.state >= 0, self.state.astype(np.uint64), self.h | _COLD)
        second = np.append(False, start[:-1])[:n]
        self.u = np.append(np.zeros(2, np.uint64), own[:-2])[:n]
        self.u[second] = s.begin
        self.u[start] = s.none
        self.plain = (self.state >= 0) & (self.v >= 0)
        self.pair = np.where(self.plain, self.v * s.size + self.state, -1)


def hot_ngrams(train: DataFrame, states, n: int) -> dict[str, np.ndarray]:
    """Pairs and triples, in order, that have a large share of the training tokens (``HOT`` of either at most), and
    their exact counts. A triple is its pair's place among the hot ones * (states + 1) + u."""
    spark = train.sparkSession
    least = max(2, -(-n // HOT))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = states.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        for b in arrays.small(batches, 0):
            w = Walk(s, arrays.as_bytes(b.column(0)))
            known = w.plain & (w.u < s.size)
            for k, x in enumerate((w.pair[w.plain], w.u[known].astype(np.int64) * s.size**2 + w.pair[known])):
                x, c = np.unique(x, return_counts=True)
                x, c = _summed(np.concatenate((held[k][0], x)), np.concatenate((held[k][1], c)))
                if len(x) > HELD:  # the rarest are let go
                    top = np.sort(np.argpartition(c, -HELD // 2)[-HELD // 2 :])
                    x, c = x[top], c[top]
                held[k] = x, c
        for k, (x, c) in enumerate(held):
            top = np.argsort(c)[-2 * HOT :]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), k)), pa.array(x[top]), pa.array(c[top])], ["kind", "x", "n"])

    found = train.select("text").mapInArrow(often, "kind long, x long, n long").groupBy("kind", "x").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= least).select("kind", "x").collect()  # HOT of either at most: their counts are parts of n
    s = states.value
    pairs = np.sort(np.array([r["x"] for r in rows if r["kind"] == 0], dtype=np.int64))
    triples = np.array([r["x"] for r in rows if r["kind"] == 1], dtype=np.int64)
    at, there = _among(pairs, triples % s.size**2)
    triples = np.sort((at * (s.size + 1) + triples // s.size**2)[there])
    shared = spark.sparkContext.broadcast((pairs, triples))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (pairs, triples) = states.value, shared.value
        count = np.zeros(len(pairs) + len(triples), np.int64)
        for b in arrays.small(batches, 0):
            w = Walk(s, arrays.as_bytes(b.column(0)))
            at, hot = _among(pairs, w.pair)
            count[: len(pairs)] += np.bincount(at[hot], minlength=len(pairs))
            known = hot & (w.u < s.size)
            of, hot = _among(triples, at[known] * (s.size + 1) + w.u[known].astype(np.int64))
            count[len(pairs) :] += np.bincount(of[hot], minlength=len(triples))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], ["at", "n"])

    count = np.zeros(len(pairs) + len(triples), np.int64)
    if len(pairs):
        for r in train.select("text").mapInArrow(exact, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # a row for each hot one
            count[r[0]] = r[1]
    return {"pairs": pairs, "pair_counts": count[: len(pairs)], "triples": triples, "triple_counts": count[len(pairs) :]}


# --- packed events
def _stepped(uid: np.ndarray, at: np.ndarray) -> Iterator[tuple[bytes, bytes, np.ndarray]]:
    """Ascending row numbers as a first one and 16-bit steps, anew where a step is too long: (first, steps, their part of ``at``)."""
    gaps = np.diff(uid, prepend=uid[:1])
    cuts = [0, *np.flatnonzero(gaps > 65535).tolist(), len(uid)]
    for a, b in zip(cuts, cuts[1:]):
        gaps[a] = 0
        yield uid[a : a + 1].tobytes(), gaps[a:b].astype(np.uint16).tobytes(), at[a:b]


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, which of them each event is of) of packed events."""
    numbers, docs, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    for base, steps in zip(table["rows"].to_pylist(), table["step"].to_pylist()):
        gaps = np.frombuffer(steps, np.uint16)
        new = gaps > 0
        new[0] = True
        numbers.append(np.frombuffer(base, np.int64)[0] + np.cumsum(gaps, dtype=np.int64)[new])
        docs.append((np.cumsum(new) - 1 + n).astype(np.int32))
        n += len(numbers[-1])
    return np.concatenate(numbers), np.concatenate(docs)


def _planes(u: np.ndarray) -> bytes:
    """Codes of tokens: 16 bits, the next 8 (255 for cold words), and the hashes of the cold ones."""
    cold = u >= _COLD
    return u.astype(np.uint16).tobytes() + np.where(cold, 255, u >> np.uint64(16)).astype(np.uint8).tobytes() + u[cold].tobytes()


def _codes(table: pa.Table) -> np.ndarray:
    """The codes of :func:`_planes` of all rows."""
    out = [np.zeros(0, np.uint64)]
    for x, steps in zip(table["u"].to_pylist(), table["step"].to_pylist()):
        n = len(steps) // 2
        high = np.frombuffer(x, np.uint8, n, 2 * n)
        u = np.frombuffer(x, np.uint16, n).astype(np.uint64) | high.astype(np.uint64) << np.uint64(16)
        if len(x) > 3 * n:
            u[high == 255] = np.frombuffer(x, np.uint64, -1, 3 * n)
        out.append(u)
    return np.concatenate(out)


def _packed(kind: int, bucket: np.ndarray, uid: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, slices: int = 1) -> Iterator[dict]:
    """Rows of events, by bucket (and slice, of which ``bucket`` is made too); ``uid`` is ascending."""
    for k, at in _split(bucket):
        for base, gaps, use in _stepped(uid[at], at):
            yield {"bucket": k // slices, "kind": kind + k % slices, "rows": base, "step": gaps, "a": a[use].tobytes(), "b": b[use].tobytes(), "u": _planes(u[use])}


_ON = np.dtype([("v", "<u8"), ("c", "<i8"), ("trained", "?")])
_NEXT = np.dtype([("w", "<u8"), ("trained", "?")])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the different combinations of the keys."""
    out = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        _, x = np.unique(k, return_inverse=True)
        _, out = np.unique(out * (int(x.max(initial=0)) + 1) + x, return_inverse=True)
    return out


def _numerators(s: States, pair: np.ndarray, u: np.ndarray, trained: np.ndarray, second: np.ndarray) -> np.ndarray:
    """log10 of c(uvw) + TRIGRAM * P(w | v) of events; of first tokens, which have no u, P(w | v) itself.

    ``pair`` has numbers from 0, ``second`` is P(w | v)."""
    _, v = np.unique(u, return_inverse=True)
    _, of = np.unique(pair * (int(v.max(initial=0)) + 1) + v, return_inverse=True)
    seen = np.bincount(of[trained], minlength=len(pair))
    return np.log10(np.where(u == s.none, second, seen[of] + TRIGRAM * second))


def _weights(s: States, pair: np.ndarray, u: np.ndarray, trained: np.ndarray, first: np.ndarray, history: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the events of whole pairs add: their token's numerator and, but after an end, the next one's denominator.

    ``first`` is P(w), ``history`` c(v) + BIGRAM."""
    c = np.bincount(pair[trained], minlength=len(pair))[pair]
    return _numerators(s, pair, u, trained, p2(c, first, history)) - np.where(ends, 0, np.log10(c + TRIGRAM))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.select(F.col("doc_id").cast("long"), "text", split.alias("held_out"))
    train = docs.where("NOT held_out")
    vocabulary = counts(train, buckets)
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = int(total[0]), int(total[1])
    states = spark.sparkContext.broadcast(States(*frequent(vocabulary), n, v))
    hot = spark.sparkContext.broadcast(hot_ngrams(train, states, n))
    place = lambda x, n=buckets: (arrays.mix(x) % np.uint64(n)).astype(np.int64)
    home = lambda h: (h % np.uint64(buckets)).astype(np.int64)  # noqa: E731  as the vocabulary's

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, known = states.value, hot.value
        pairs, pair_counts = known["pairs"], known["pair_counts"]
        second = p2(pair_counts, s.prob[pairs % s.size], s.history[pairs // s.size])
        after = np.where(pairs % s.size == s.end, 0, -np.log10(pair_counts + TRIGRAM))
        triples = known["triples"]
        triple = np.log10(known["triple_counts"] + TRIGRAM * second[triples // (s.size + 1)])
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = []
            for i, kind in enumerate((PAIR, SECOND, FIRST, BOTH, HOT_PAIR)):
                bucket, uid, a, b, u = (np.concatenate(x) for x in zip(*[h[i] for h in held]))
                out += _packed(kind, bucket, uid, a, b, u, SLICES if kind == PAIR else 1)
            uid, made = (np.concatenate(x) for x in zip(*[h[-1] for h in held]))
            for b, at in _split(uid % buckets):
                out.append({"bucket": b, "kind": ROWS, "rows": uid[at].tobytes(), "step": b"", "a": made[at].tobytes(), "b": b"", "u": b""})
            return pa.RecordBatch.from_pylist(out, schema=_EVENT_SCHEMA)

        size = 0
        with np.errstate(over="ignore"):
            for b in arrays.small(batches, 1):
                w = Walk(s, arrays.as_bytes(b.column(1)))
                uid = b.column(0).to_numpy()
                trained = ~b.column(2).to_numpy(zero_copy_only=False).astype(bool)[w.d]
                at, warm = _among(pairs, w.pair)
                weight = np.zeros(len(w.h))
                weight[warm] = after[at[warm]]
                first = warm & (w.u == s.none)
                weight[first] += np.log10(second[at[first]])
                rest = warm & ~first
                near = rest & (w.u < s.size)
                of, there = _among(triples, at[near] * (s.size + 1) + w.u[near].astype(np.int64))
                done = np.flatnonzero(near)[there]
                weight[done] += triple[of[there]]
                rest[done] = False

                mark = np.where(trained, _TOP, np.uint32(0))
                events = []
                i = np.flatnonzero(w.plain & ~warm)
                key = w.pair[i].astype(np.uint64)
                events.append((place(key, buckets * SLICES), uid[w.d[i]], key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint8) | trained[i].astype(np.uint8) << 7, w.u[i]))
                i = np.flatnonzero((w.state < 0) & (w.v >= 0))
                events.append((home(w.h[i]), uid[w.d[i]], w.h[i], w.v[i].astype(np.uint32) | mark[i], w.u[i]))
                i = np.flatnonzero((w.state >= 0) & (w.v < 0))
                events.append((home(w.v_hash[i]), uid[w.d[i]], w.v_hash[i], w.state[i].astype(np.uint32) | mark[i], w.u[i]))
                i = np.flatnonzero((w.state < 0) & (w.v < 0))
                both = np.zeros(len(i), _NEXT)
                both["w"], both["trained"] = w.h[i], trained[i]
                events.append((home(w.v_hash[i]), uid[w.d[i]], w.v_hash[i], both, w.u[i]))
                i = np.flatnonzero(rest)
                events.append((place(at[i].astype(np.uint64) * np.uint64(s.size + 1) + w.u[i]), uid[w.d[i]], at[i].astype(np.uint16) | trained[i].astype(np.uint16) << 15, np.zeros(len(i), np.uint8), w.u[i]))

                add = lambda use, x: np.bincount(w.d[use], x, minlength=b.num_rows)
                there = w.state >= 0
                c = s.count[w.state[there]]
                ids = b.column(3)
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                made = [ids.fill_null(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + 2 * null, np.bincount(w.d, minlength=b.num_rows), add(there, c > 0).astype(np.int64), add(there, np.log10(s.p1(c))).view(np.int64), np.bincount(w.d, weight, minlength=b.num_rows).astype(np.float64).view(np.int64)]
                events.append((uid, np.ascontiguousarray(np.stack(made, 1).astype(np.int64)).view("V48").ravel()))
                held.append(tuple(events))
                size += len(w.h)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    def sums(found: list[tuple]) -> Iterator[dict]:
        """Rows of sums, by part, of lists of (row numbers, known words or None, base or None, score)."""
        plain = [x for x in found if x[1] is None]
        if plain:
            plain = [(np.concatenate([x[0] for x in plain]), None, None, np.concatenate([x[3] for x in plain]))]
        for uid, known, base, sc in plain + [x for x in found if x[1] is not None]:
            numbers, at = np.unique(uid, return_inverse=True)
            known, base, sc = (None if x is None else np.bincount(at, x, minlength=len(numbers)) for x in (known, base, sc))
            for p, use in _split(numbers % parts):  # in order, so that differences are small
                text = lambda x, t: b"" if x is None else x[use].astype(t).tobytes()
                yield {"bucket": p, "kind": SUMS, "rows": np.diff(numbers[use], prepend=0).tobytes(), "step": b"", "a": text(known, np.uint32), "b": text(base, np.float64), "u": text(sc, np.float64)}

    def vocabulary_of(right: pa.Table):
        words, count = _summed(_cat(right["hashes"], np.uint64), _cat(right["counts"], np.int64))

        def of(h: np.ndarray) -> np.ndarray:
            at, there = _among(words, h)
            return np.where(there, count[at] if len(count) else 0, 0)

        return of

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        s, known = states.value, hot.value
        kinds = np.array(left["kind"].to_pylist(), dtype=np.int64)
        table = lambda k: left.filter(pa.array(kinds == k))
        count = vocabulary_of(right)
        out, found = [], []
        total = lambda doc, uid, x: np.bincount(doc, x, minlength=len(uid))

        for k in range(SLICES):
            if (t := table(PAIR + k)).num_rows:
                uid, doc = _rows_of(t)
                high, u = _cat(t["b"], np.uint8), _codes(t)
                pairs, of = np.unique((high & np.uint8(127)).astype(np.int64) << 32 | _cat(t["a"], np.uint32), return_inverse=True)
                v, w = pairs // s.size, pairs % s.size
                found.append((uid, None, None, total(doc, uid, _weights(s, of, u, high > 127, s.prob[w][of], s.history[v][of], (w == s.end)[of]))))
        if (t := table(SECOND)).num_rows:
            uid, doc = _rows_of(t)
            h, v = _cat(t["a"], np.uint64), _cat(t["b"], np.uint32)
            trained, v, c = v >= _TOP, v & ~_TOP, count(h)
            sc = _weights(s, _dense(h, v), _codes(t), trained, s.p1(c), s.history[v], np.zeros(len(h), bool))
            found.append((uid, total(doc, uid, c > 0), total(doc, uid, np.log10(s.p1(c))), total(doc, uid, sc)))
        if (t := table(FIRST)).num_rows:
            uid, doc = _rows_of(t)
            h, w = _cat(t["a"], np.uint64), _cat(t["b"], np.uint32)
            trained, w = w >= _TOP, w & ~_TOP
            sc = _weights(s, _dense(h, w), _codes(t), trained, s.prob[w], count(h) + BIGRAM, w == s.end)
            found.append((uid, None, None, total(doc, uid, sc)))
        if (t := table(HOT_PAIR)).num_rows:
            uid, doc = _rows_of(t)
            at = _cat(t["a"], np.uint16)
            trained, at = at >= 1 << 15, (at & np.uint16((1 << 15) - 1)).astype(np.int64)
            second = p2(known["pair_counts"], s.prob[known["pairs"] % s.size], s.history[known["pairs"] // s.size])
            found.append((uid, None, None, total(doc, uid, _numerators(s, at, _codes(t), trained, second[at]))))
        if (t := table(BOTH)).num_rows:
            uid, doc = _rows_of(t)
            order = np.argsort(uid[doc], kind="stable")
            h, w, u = _cat(t["a"], np.uint64)[order], _cat(t["b"], _NEXT)[order], _codes(t)[order]
            on = np.zeros(len(h), _ON)
            on["v"], on["c"], on["trained"] = h, count(h), w["trained"]
            out += _packed(ONWARD, home(w["w"]), uid[doc][order], w["w"], on, u)
        out += sums(found)
        t = table(ROWS)
        uid = _cat(t["rows"], np.int64)
        made = _cat(t["a"], np.int64).reshape(-1, 6).view("V48").ravel()
        for p, at in _split(uid % parts):
            out.append({"bucket": p, "kind": ROWS, "rows": uid[at].tobytes(), "step": b"", "a": made[at].tobytes(), "b": b"", "u": b""})
        return pa.Table.from_pylist(out, schema=_EVENT_SCHEMA)

    def onward(left: pa.Table, right: pa.Table) -> pa.Table:
        """The pairs of two cold words, in the task of the second one."""
        s, found = states.value, []
        if left.num_rows:
            uid, doc = _rows_of(left)
            h, on = _cat(left["a"], np.uint64), _cat(left["b"], _ON)
            c = vocabulary_of(right)(h)
            sc = _weights(s, _dense(h, on["v"]), _codes(left), on["trained"], s.p1(c), on["c"] + BIGRAM, np.zeros(len(h), bool))
            add = lambda x: np.bincount(doc, x, minlength=len(uid))
            found.append((uid, add(c > 0), add(np.log10(s.p1(c))), add(sc)))
        return pa.Table.from_pylist(list(sums(found)), schema=_EVENT_SCHEMA)

    final = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [r for r in rows if r["kind"] == ROWS]
        uid = np.concatenate([np.frombuffer(r["rows"], np.int64) for r in own])
        made = np.concatenate([np.frombuffer(r["a"], np.int64).reshape(-1, 6) for r in own])
        order = np.argsort(uid)
        uid, made = uid[order], made[order]
        known, base, sc = made[:, 3].astype(np.float64), np.ascontiguousarray(made[:, 4]).view(np.float64).copy(), np.ascontiguousarray(made[:, 5]).view(np.float64).copy()
        for r in rows:
            if r["kind"] == SUMS:
                at = np.searchsorted(uid, np.cumsum(np.frombuffer(r["rows"], np.int64)))  # each row once
                sc[at] += np.frombuffer(r["u"], np.float64)
                if r["a"]:
                    known[at] += np.frombuffer(r["a"], np.uint32)
                    base[at] += np.frombuffer(r["b"], np.float64)
        ids = pa.array(made[:, 0], mask=made[:, 1] >= 2)
        return pa.Table.from_arrays([ids, pa.array(made[:, 1] % 2 == 1), pa.array(made[:, 2]), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(sc)], schema=final)

    # A row's number only has to hold within this one job, and a repeated task gives the same.
    events = docs.select(F.monotonically_increasing_id().alias("uid"), "text", "held_out", "doc_id").mapInArrow(traverse, _EVENTS)
    found = settle(events.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(resolve, _EVENTS), "sums")
    cold = found.where(F.col("kind") == ONWARD).groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(onward, _EVENTS)
    both = found.where(F.col("kind") != ONWARD).unionAll(cold)
    out = both.groupBy("bucket").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
