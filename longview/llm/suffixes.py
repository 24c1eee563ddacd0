"""Removal of repeated byte strings by suffix arrays.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts in a document with
a smaller id. Documents are judged on the input, and matches never cross documents.

1. Anchors. Every window of LENGTH bytes picks the smallest of its hashed grams (leftmost if tied), so
   equal windows pick equal anchors, one for some fourteen bytes. Anchors that occur in two documents or
   more are found by a shuffle of their hashes alone; windows of other anchors can't repeat.
2. Suffix arrays. The windows that picked a repeated anchor go, with their bytes, to the task of that
   anchor. Windows of whole anchors form shards of bounded size. Each shard gets the suffix array of its windows by
   Larsson-Sadakane refinement: ranks by eight bytes, then by 16, 32 and LENGTH, each from two ranks of the step
   before, only places that are still tied being sorted again. Kasai's common prefixes of neighbours part the
   array into classes of equal windows. Equal windows meet in one shard, as they have one anchor; only where an anchor
   fills several, these are merged by their sorted classes, in ranges found by binary search.
   A hot anchor, which a great many documents have, would gather unlike windows in one task: its windows go each to
   the task of their own bytes instead.
3. Windows whose class has a smaller document id are marked, and each document's marks are united.

Blocks of documents settle what they can before each shuffle: of equal anchors, or equal runs of windows,
one goes on, so a passage that a third of all documents share costs a row for each block. Documents
without a repeated anchor are never shuffled, as long as the ids of the others can be broadcast.

Hashes only choose what is compared, and stand for equal runs within a block (64 bits, with length and
anchor); windows are compared by their bytes.

Defined cases: a null text is empty; a null id neither removes nor loses anything; rows with one id don't
remove from each other; texts shorter than LENGTH lose nothing; an empty table gives an empty table;
further columns are kept in ``row``. Long texts are taken in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import arrays
from .common import BROADCAST_KEYS, is_small, settle, small_batches

LENGTH = 50
GRAM = 24
BLOCK = 2_000_000
SHARD = 500_000
#: Bytes of text for each part and bucket, at most: their number follows the table's size.
PART = 1 << 24
#: An anchor is hot if as many documents have it and they are a share of all of one in ``HOT_SHARE`` or more.
HOT, HOT_SHARE = 10_000, 4096
_LOW = np.uint64((1 << 22) - 1)
#: A segment's windows and, in the high bits, 16 bits of its anchor's hash.
_N_BITS, _N = np.uint64(48), np.uint64((1 << 48) - 1)


# --- suffix arrays
def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``text`` on, as a big-endian number, zeros following its end."""
    text = np.concatenate((text, np.zeros(LENGTH + 8, np.uint8)))
    return np.ndarray(len(text) - 7, dtype=">u8", buffer=text, strides=(1,))


def _steps(depth: int) -> list[int]:
    """How far on the ranks are that double the compared length, from eight bytes to ``depth``."""
    out, h = [], 8
    while h < depth:
        out.append(min(h, depth - h))
        h += out[-1]
    return out


def suffix_array(eights: np.ndarray, start: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the windows, sorted by their ``depth`` >= 8 bytes, by Larsson-Sadakane refinement.

    Segment k has ``count[k]`` windows, from byte ``start[k]`` on, and ``depth`` - 1 bytes more; windows are numbered through.
    Ranks by the first h bytes and the ranks h bytes on give ranks by 2h bytes; a place that shares its
    rank with no other is sorted no more, and a place is ranked only as far as windows look at it.
    """
    steps = _steps(depth)
    first = np.cumsum(count) - count

    def places(reach: int) -> np.ndarray:
        size = count + reach
        return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)

    def first_of(x: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1])[: len(x)], np.arange(len(x)), 0))

    rank = np.zeros(len(eights), dtype=np.uint32)
    near = np.zeros(len(eights), dtype=bool)
    at = places(sum(steps))
    key = eights[at].astype(np.uint64)
    if depth < 8:
        key >>= np.uint64(8 * (8 - depth))
    by = np.argsort(key)
    at, key = at[by], key[by]
    rank[at] = first_of(key)
    for k, step in enumerate(steps):
        same = key[1:] == key[:-1]
        tied = np.append(False, same) | np.append(same, False)
        near[:] = False
        near[places(sum(steps[k + 1 :]))] = True
        at = at[tied[: len(at)]]
        at = at[near[at]]
        key = rank[at].astype(np.uint64) << np.uint64(32) | rank[at + step]
        by = np.argsort(key)
        at, key = at[by], key[by]
        group = key >> np.uint64(32)
        rank[at] = group + (first_of(key) - first_of(group)).astype(np.uint64)
    window = np.arange(int(count.sum()))
    return np.argsort(rank[window + np.repeat(start - first, count)])


def kasai(eights: np.ndarray, start: np.ndarray, count: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth`` bytes, of each window in ``order`` with the one before (0 for the first).

    As Kasai's: if a window has h bytes in common with the one before it in order, and what follows that one in the text
    comes before what follows the window (with h < ``depth`` it does, if it is a window), this has
    h - 1 at least. All segments are gone through side by side, a window of each at a time.
    """
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    first = np.cumsum(count) - count
    at = np.arange(n) + np.repeat(start - first, count)
    last = np.zeros(n, dtype=bool)
    last[(first + count - 1)[count > 0]] = True
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.arange(n)
    before = np.append(0, order[:-1])[:n]
    lanes = np.argsort(-count, kind="stable")
    sizes = count[lanes]
    held = np.zeros(len(lanes), dtype=np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, "left"))  # the lanes with more than t windows
        w = first[lanes[:live]] + t
        r = rank[w]
        other = before[r]
        h = np.where(r > 0, np.maximum(held[:live] - 1, 0), 0)
        go = np.flatnonzero((r > 0) & (h < depth))
        while len(go):
            x = eights[at[w[go]] + h[go]].astype(np.uint64) ^ eights[at[other[go]] + h[go]].astype(np.uint64)
            same = sum((x < np.uint64(1 << b)).astype(np.int64) for b in range(0, 64, 8))
            h[go] += same
            go = go[(same == 8) & (h[go] < depth)]
        h = np.minimum(h, depth)
        out[r] = h
        held[:live] = np.where(last[other] | (rank[other + 1] > rank[w + 1]), 0, h)
    return out


# --- anchors
def runs(buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, of texts of the given sizes that follow one another in ``buf``:
    (text, first window, windows, 48 bits of the anchor's hash)."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    with np.errstate(over="ignore"):
        s = arrays.sums(arrays.TABLE[buf])
        g = arrays.mix((s[GRAM:] - s[:-GRAM]) * arrays.powers(n + 1)[1][: n - GRAM + 1])
    least = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    span, k = LENGTH - GRAM + 1, 1
    while 2 * k <= span:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < span:
        least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
    pick = (least & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[: n - LENGTH + 1]
    valid = np.arange(n - LENGTH + 1) + LENGTH <= np.cumsum(sizes)[text]
    new = valid & np.concatenate(([True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    upto = np.concatenate(([0], np.cumsum(valid)))
    count = np.diff(np.append(upto[first], upto[-1]))
    return text[first], first, count, g[pick[first]] >> np.uint64(16)


def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, sizes, text numbers, offsets): texts in buffers of bounded size; long ones overlap."""
    part: list[bytes] = []
    of: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, max(1, len(t) - LENGTH + 1), arrays.PIECE):
            x = t[at : at + arrays.PIECE + LENGTH - 1] if len(t) > arrays.PIECE else t
            if part and size + len(x) > arrays.PIECE:
                yield _part(part, of)
                part, of, size = [], [], 0
            part.append(x)
            of.append((i, at))
            size += len(x)
            if x is t:
                break
    if part:
        yield _part(part, of)


def _part(part, of):
    return np.frombuffer(b"".join(part), np.uint8), np.fromiter(map(len, part), np.int64, len(part)), np.array([i for i, _ in of]), np.array([a for _, a in of])


_PACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("ids", pa.binary()), ("of", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("data", pa.binary())])
_PACKED = "bucket int, kind byte, ids binary, of binary, a binary, b binary, data binary"
_HITS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("of", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_HIT = "part int, ids binary, of binary, a binary, b binary"


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows that have it), rows in order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)]):
        yield int(key[order[a]]), order[a:b]


def _packed(ids: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
    """``at`` in order of its documents, and these: their rows of ``ids`` once each, and where each is next."""
    at = at[np.argsort(doc[at], kind="stable")]
    of = doc[at]
    step = np.append(False, of[1:] != of[:-1])[: len(of)]
    first = np.append(True, step[1:])[: len(of)]
    return at, {"ids": ids[of[first]].tobytes(), "of": step.astype(np.uint8).tobytes()}


def _by_part(ids: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int) -> Iterator[dict]:
    """Rows about documents, packed by the partition that their documents go to."""
    for p, at in _split((ids[doc, -1] % parts) if len(doc) else np.zeros(0, np.int64)):
        at, row = _packed(ids, doc, at)
        yield {"part": p, **row, "a": a[at].tobytes(), "b": b[at].tobytes()}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _unpack(rows: list[dict], a_type, b_type, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc, a, b) of packed rows."""
    ids = [np.frombuffer(r["ids"], np.int64).reshape(-1, width) for r in rows]
    shift = np.cumsum([0, *map(len, ids)])
    doc = [np.cumsum(np.frombuffer(r["of"], np.uint8), dtype=np.int64) + s for r, s in zip(rows, shift)]
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return np.concatenate(ids) if ids else np.zeros((0, width), np.int64), cat(doc, np.int64), cat([np.frombuffer(r["a"], a_type) for r in rows], a_type), cat([np.frombuffer(r["b"], b_type) for r in rows], b_type)


def _low_high(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits as 32 and 16."""
    return h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low


def _anchor_rows(ids: np.ndarray, doc: np.ndarray, h: np.ndarray, buckets: int) -> list[dict]:
    """A block's anchors: those of one document (kind 0), one of each that several have (kind 2, with their number), and
    which documents these are (kind 1)."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    h, doc = h[once], doc[once]
    first = np.append(True, h[1:] != h[:-1])[: len(h)]
    size = np.diff(np.append(np.flatnonzero(first), len(h)))
    several = np.repeat(size > 1, size)
    holders = np.repeat(size, size).astype(np.uint32)
    rows = []
    none = {"ids": b"", "of": b""}
    for kind, use in ((0, ~several), (2, several & first), (1, several)):
        at = np.flatnonzero(use)
        where = (h[at] % np.uint64(buckets)).astype(np.int64) if kind != 1 else doc[at] % buckets
        for b, rows_of in _split(where):
            x, row = _packed(ids, doc, at[rows_of]) if kind != 2 else (at[rows_of], none)
            low, high = _low_high(h[x])
            rows.append({"bucket": b, "kind": kind, **row, "a": low.tobytes(), "b": high.tobytes(), "data": holders[x].tobytes() if kind == 2 else b""})
    return rows


def _leaders(data: bytes, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which segments go on: of those with equal bytes the ones of the smallest owner. All windows of the others are marked."""
    least: dict[bytes, int] = {}
    texts = [data[a : a + n] for a, n in zip(start.tolist(), size.tolist())]
    owners = owner.tolist()
    for t, o in zip(texts, owners):
        if least.setdefault(t, o) > o:
            least[t] = o
    return np.fromiter((least[t] == o for t, o in zip(texts, owners)), bool, len(texts))


def _shards(count: np.ndarray, key: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Lists of shards (first segment, next one's first) of some SHARD windows, of segments in order of ``key``.

    Shards end where a key does. Only one key's windows that are too many for a shard go to several, which make one list.
    """
    ends = np.append(0, np.cumsum(count))
    borders = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]), len(key))

    def fit(lo: int) -> int:
        return max(lo + 1, int(np.searchsorted(ends, ends[lo] + SHARD, "right")) - 1)

    lo = 0
    while lo < len(key):
        hi = int(borders[np.searchsorted(borders, fit(lo), "right") - 1])
        if hi > lo:
            yield [(lo, hi)]
        else:
            hi, own = int(borders[np.searchsorted(borders, lo, "right")]), []
            while lo < hi:
                own.append((lo, min(hi, fit(lo))))
                lo = own[-1][1]
            yield own
        lo = hi


def _merge(shards: list[dict]) -> None:
    """Equal classes of the shards share the smallest owner: the sorted classes are merged range by range, whose bounds
    are found by binary search."""
    step = max(1, SHARD // 500)
    some = np.sort(np.concatenate([s["keys"][::step] for s in shards]))[500::500]
    bounds = [np.concatenate(([0], np.searchsorted(s["keys"], some), [len(s["keys"])])) for s in shards]
    for r in range(len(some) + 1):
        at = [slice(b[r], b[r + 1]) for b in bounds]
        keys = np.concatenate([s["keys"][x] for s, x in zip(shards, at)])
        least = np.concatenate([s["least"][x] for s, x in zip(shards, at)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        if len(keys):
            least[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(keys))))
        for s, x in zip(shards, at):
            s["least"][x], least = least[: x.stop - x.start], least[x.stop - x.start :]


def _marks(segments, ids, doc, key=None) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of each window whose bytes also stand in a segment of a smaller document.

    ``segments``: (bytes, start of each segment, its windows). Segments with equal windows have equal numbers in ``key``."""
    text, start, count = segments
    key = np.zeros(len(start), np.int64) if key is None else key
    by = np.argsort(key, kind="stable")
    start, count, doc, key = start[by], count[by], doc[by], key[by]
    seg_of, inside_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for several in _shards(count, key):
        shards = []
        for lo, hi in several:
            own, size = count[lo:hi], count[lo:hi] + LENGTH - 1
            place = np.cumsum(size) - size
            part = text[np.arange(int(size.sum())) + np.repeat(start[lo:hi] - place, size)]
            eights = _eights(part)
            order = suffix_array(eights, place, own, LENGTH)
            new = kasai(eights, place, own, order, LENGTH) < LENGTH
            first = np.flatnonzero(new)
            seg = np.repeat(np.arange(lo, hi), own)[order]
            inside = order - (np.cumsum(own) - own)[seg - lo]
            owner = ids[doc[seg], 0]
            shards.append({"class": np.cumsum(new) - 1, "seg": seg, "inside": inside, "owner": owner, "least": np.minimum.reduceat(owner, first)})
            if len(several) > 1:
                at = (start[seg] + inside)[first]
                shards[-1]["keys"] = np.stack([text[at + i] for i in range(LENGTH)], 1).view(f"S{LENGTH}").ravel()
        if len(several) > 1:
            _merge(shards)
        for s in shards:
            hit = s["least"][s["class"]] < s["owner"]
            seg_of.append(by[s["seg"][hit]])
            inside_of.append(s["inside"][hit])
    return np.concatenate(seg_of), np.concatenate(inside_of)


def _intervals(seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, count) of the runs of marked windows."""
    order = np.lexsort((at, seg))
    seg, at = seg[order], at[order]
    cut = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1))[: len(seg)])
    return seg[cut], at[cut], np.diff(np.append(cut, len(seg)))


def repeats(docs: DataFrame) -> tuple[DataFrame, int]:
    """(packed marks by part, parts): the windows of each document that a smaller id has too.

    ``docs`` has doc_id (long), key (long, a hash of id and text) and text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total[1] // PART))
    least = max(HOT, total[0] // HOT_SHARE)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, doc, h, n, rows = [], [], [], 0, 0
        for b in batches:
            for _, first, count, hashes, of, _ in _runs_of(arrays.as_bytes(b.column(1))):
                doc.append(of + rows)
                h.append(hashes)
                n += len(hashes)
            ids.append(b.column(0).to_numpy().reshape(-1, 1))
            rows += b.num_rows
            if n >= BLOCK:
                yield _batch(_anchor_rows(np.concatenate(ids), np.concatenate(doc), np.concatenate(h), buckets), _PACK)
                ids, doc, h, n, rows = [], [], [], 0, 0
        if n:
            yield _batch(_anchor_rows(np.concatenate(ids), np.concatenate(doc), np.concatenate(h), buckets), _PACK)

    def repeated(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        one, several, known = ([r for r in rows if r["kind"] == k] for k in (0, 2, 1))
        ids, doc, low, high = _unpack(one, np.uint32, np.uint16, 1)
        h, many = _whole(low, high), np.unique(_whole(*_unpack(several, np.uint32, np.uint16, 1)[2:]))
        order = np.argsort(h, kind="stable")
        first = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
        size = np.diff(np.append(np.flatnonzero(first), len(h)))
        hit = order[np.repeat(size > 1, size)]
        hit = np.union1d(hit, np.flatnonzero(np.isin(h, many)))
        held = np.concatenate([np.ones(len(h), np.int64), *(np.frombuffer(r["data"], np.uint32).astype(np.int64) for r in several)])
        every, of = np.unique(np.concatenate([h, _whole(*_unpack(several, np.uint32, np.uint16, 1)[2:])]), return_inverse=True)
        low_hot, high_hot = _low_high(every[np.bincount(of, held, minlength=len(every)) >= least]) if len(every) else (low[:0], high[:0])
        out = [*_by_part(ids, doc[hit], low[hit], high[hit], parts), *_by_part(*_unpack(known, np.uint32, np.uint16, 1), parts)]
        out.append({"part": -1, "ids": b"", "of": b"", "a": low_hot.tobytes(), "b": high_hot.tobytes()})
        return pa.Table.from_pylist(out, schema=_HITS)

    packed = docs.select("key", "text").mapInArrow(anchors, _PACKED)
    hits = settle(packed.groupBy("bucket").applyInArrow(repeated, _HIT), "anchors")
    marked = hits.where("part < 0").select("a", "b").collect()  # of the anchors of a document HOT_SHARE times as many are hot at most
    hot = spark.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.uint64), *(_whole(np.frombuffer(r["a"], np.uint32), np.frombuffer(r["b"], np.uint16)) for r in marked)])))
    hits = hits.where("part >= 0")
    some = _that_have(docs, _keys(hits, 1), "left_semi")
    some = (docs if some is None else some).select("doc_id", "key", "text", F.pmod("key", F.lit(parts)).cast("int").alias("part"))

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, own = arrays.as_bytes(left["text"]), np.stack([left["doc_id"].to_numpy(), left["key"].to_numpy()], 1) if left.num_rows else np.zeros((0, 2), np.int64)
        ids, doc, low, high = _unpack(right.to_pylist(), np.uint32, np.uint16, 1)
        keys, group = np.unique(own[:, 1], return_inverse=True)
        there = np.searchsorted(keys, ids[:, 0]).clip(max=max(0, len(keys) - 1))
        there = np.where(keys[there] == ids[:, 0], there, -1)[doc] if len(keys) else np.full(len(doc), -1)
        wanted = np.unique(there[there >= 0].astype(np.uint64) << np.uint64(48) | _whole(low, high)[there >= 0])
        _, alone = np.unique(own, axis=0, return_index=True) if len(own) else (own, np.zeros(0, np.int64))
        texts = [t if i in keep else b"" for keep in (set(alone.tolist()),) for i, t in enumerate(texts)]  # repeated rows once
        seg_doc, seg_at, seg_n, seg_h, seg_x, data = [], [], [], [], [], []
        for buf, first, count, hashes, of, offset in _runs_of(texts):
            use = np.isin(group[of].astype(np.uint64) << np.uint64(48) | hashes, wanted)
            first, count, hashes, of, offset = (x[use] for x in (first, count, hashes, of, offset))
            if len(hot.value):  # the windows of a hot anchor go each by its own bytes
                warm = np.isin(hashes, hot.value)
                by = np.repeat(np.arange(len(first)), np.where(warm, count, 1))
                step = np.arange(len(by)) - np.repeat(np.cumsum(np.where(warm, count, 1)) - np.where(warm, count, 1), np.where(warm, count, 1))
                first, offset, of = first[by] + step, offset[by] + step, of[by]
                count = np.where(warm[by], 1, count[by])
                with np.errstate(over="ignore"):
                    own_hash = arrays.span_hash(arrays.sums(arrays.TABLE[buf]), first, first + LENGTH) >> np.uint64(16)
                hashes = np.where(warm[by], own_hash, hashes[by])
            with np.errstate(over="ignore"):
                seg_x.append(arrays.span_hash(arrays.sums(arrays.TABLE[buf]), first, first + count + LENGTH - 1))
            seg_doc.append(of)
            seg_at.append(offset)
            seg_n.append(count)
            seg_h.append(hashes)
            data += [bytes(buf[a : a + n + LENGTH - 1]) for a, n in zip(first.tolist(), count.tolist())]
        cat = lambda x, t=np.int64: np.concatenate(x) if x else np.zeros(0, t)
        doc, at, n, h, x = cat(seg_doc), cat(seg_at), cat(seg_n), cat(seg_h, np.uint64), cat(seg_x, np.uint64)
        # Of equal runs those of the smallest id go on; those of larger ids are marked already.
        owner = own[doc, 0] if len(doc) else doc
        order = np.lexsort((owner, n, x, h))
        lead = np.append(True, (h[order][1:] != h[order][:-1]) | (x[order][1:] != x[order][:-1]) | (n[order][1:] != n[order][:-1]))[: len(h)]
        leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))] if len(h) else order
        marked = order[owner[leader] < owner[order]]
        out = []
        for p, w in _split(doc[marked] % buckets):
            w, row = _packed(own, doc, marked[w])
            out.append({"bucket": p, "kind": 1, **row, "a": at[w].tobytes(), "b": n[w].tobytes(), "data": b""})
        go = order[owner[leader] == owner[order]]
        shard = h // np.uint64(buckets) & np.uint64(0xFFFF)
        for p, w in _split((h[go] % np.uint64(buckets)).astype(np.int64)):
            w, row = _packed(own, doc, go[w])
            out.append({"bucket": p, "kind": 0, **row, "a": at[w].tobytes(), "b": (n[w].astype(np.uint64) | shard[w] << _N_BITS).tobytes(), "data": b"".join([data[i] for i in w.tolist()])})
        return pa.Table.from_pylist(out, schema=_PACK)

    def marks(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = [r for r in rows if r["kind"] == 1]
        rows = [r for r in rows if r["kind"] == 0]
        out = [*_by_part(*_unpack(known, np.int64, np.int64), parts)]
        ids, doc, at, n = _unpack(rows, np.int64, np.uint64)
        if len(doc):
            key, n = (n >> _N_BITS).astype(np.int64), (n & _N).astype(np.int64)
            size = n + LENGTH - 1
            data = b"".join(r["data"] for r in rows)
            go = _leaders(data, np.cumsum(size) - size, size, ids[doc, 0])
            out += _by_part(ids, doc[~go], at[~go], n[~go], parts)
            start, doc, at, n = (np.cumsum(size) - size)[go], doc[go], at[go], n[go]
            seg, inside = _marks((np.frombuffer(data, np.uint8), start, n), ids, doc, key[go])
            seg, inside, count = _intervals(seg, inside)
            out += _by_part(ids, doc[seg], at[seg] + inside, count, parts)
        return pa.Table.from_pylist(out, schema=_HITS)

    cut = some.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(segments, _PACKED)
    return cut.groupBy("bucket").applyInArrow(marks, _HIT), parts


def _runs_of(texts: list[bytes]):
    """(buffer, first, windows, anchor, text number, offset in the text) of the runs of a batch."""
    for buf, sizes, of, offset in _parts(texts):
        text, first, count, h = runs(buf, sizes)
        starts = np.cumsum(sizes) - sizes
        yield buf, first, count, h, of[text], first - starts[text] + offset[text]


def _keys(packed: DataFrame, width: int) -> DataFrame:
    """The key of each document that has rows in ``packed``, once: all rows about a document are in one part."""

    def unique(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.int64).reshape(-1, width)[:, -1] for x in table["ids"].to_pylist()]
        return pa.table({"key": np.unique(np.concatenate([np.zeros(0, np.int64), *found]))})

    return settle(packed.select("part", "ids").groupBy("part").applyInArrow(unique, "key long"), "keys")


def _that_have(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame | None:
    """The documents whose key is among ``keys`` (or is not); None if these are too many to broadcast."""
    return docs.join(F.broadcast(keys), "key", how) if is_small(keys, BROADCAST_KEYS) else None


def remove(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """row (all columns of a row of ``docs``), n_bytes, n_removed, n_spans, kept (binary) and kept_sha256.

    ``as_text`` gives kept as a string, without what a cut leaves of a character."""
    docs = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found, parts = repeats(docs.where(F.col("doc_id").isNotNull()))
    found = settle(found, "marks")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, doc, at, n = _unpack(right.to_pylist(), np.int64, np.int64)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (i, k), a, c in zip(ids[doc].tolist(), at.tolist(), n.tolist()):
            spans.setdefault((i, k), []).append((a, a + c + LENGTH - 1))
        rows = []
        result = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if as_text else pa.binary()), ("kept_sha256", pa.string())])
        for i, k, t in zip(left["doc_id"].to_pylist(), left["key"].to_pylist(), arrays.as_bytes(left["text"])):
            kept, upto, removed, pieces = [], 0, 0, 0
            end = -1
            for a, b in sorted(spans.get((i, k), ())):
                if a > end:  # a new run of removed bytes
                    kept.append(t[upto:a])
                    pieces += 1
                    removed += b - a
                elif b > end:
                    removed += b - end
                end = max(end, b)
                upto = end
            kept.append(t[upto:])
            rest = b"".join(kept)
            rows.append({"n_bytes": len(t), "n_removed": removed, "n_spans": pieces, "kept": rest.decode("utf-8", "ignore") if as_text else rest, "kept_sha256": hashlib.sha256(rest).hexdigest()})
        out = pa.Table.from_pylist(rows, schema=result)
        return out.add_column(0, "row", left["row"])

    part = F.pmod("key", F.lit(parts)).cast("int").alias("part")
    keys = _keys(found, 2)
    touched, whole = _that_have(docs.where("doc_id IS NOT NULL"), keys, "left_semi"), _that_have(docs, keys, "left_anti")
    if touched is None:
        touched, whole = docs, None
    schema = T.StructType([docs.schema["row"], *T._parse_datatype_string(f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, kept_sha256 string").fields])
    lost = touched.select("row", "doc_id", "key", "text", part).groupBy("part").cogroup(found.groupBy("part")).applyInArrow(cut, schema)
    if whole is None:
        return lost
    text = F.col("text").cast("binary")
    zero = F.lit(0).cast("long")
    return lost.unionAll(whole.select("row", F.octet_length("text").cast("long"), zero, zero, F.col("text") if as_text else text, F.sha2(text, 256)))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` with the rest of each text; what a cut leaves of a character goes too."""
    out = remove(docs, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
