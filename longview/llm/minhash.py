"""Near-duplicate documents by bottom-k sketches of one hash function.

Documents are linked where 100 * intersection >= 80 * union of their sets of word shingles.

1. Sketches. One pass over the texts keeps of each set its size, a 128-bit fingerprint and its ``SKETCH`` smallest
   hashes. Texts with equal sets form a class, which goes on with its smallest id.
2. Inverted lists. Every retained value gets its list of documents. Linked sets share at least ``need`` retained
   values: surely ceil(0.8 n) where both sketches are whole sets, else half of ``SKETCH``, which a pair at the limit
   misses by a chance of 2e-8. So of each sketch only the ``size - need + 1`` rarest values are listed (rarity as
   counted over all sketches, the same for all documents): two that are linked still meet, and passages that many
   documents share are in no list unless a document is made of little else. Values of one document are not listed.
3. Overlaps. In each list every document is paired with the list's hub (its document with most values listed, the
   smallest id of equals), and keeps the hub with which it has the largest overlap. Pairs whose union sketch (the
   ``SKETCH`` smallest values of both) has less than ``FLOOR`` of its values in both are dropped, a linked one by a chance of
   2e-8 again; the others are confirmed on full sets, and linked documents get one label.
4. Then only documents of one list with different labels are paired: in lists of up to ``SHORT`` directly, in longer
   ones where their edits of the list's hub leave room for a link (:func:`_off_hub`, which loses none). These pairs
   pass the union sketch and the full sets as well. So a group of thousands of near copies costs
   about as many pairs, not their square.

``near_duplicates(..., sketch=None)`` is the exact way: it retains whole sets, so that steps 2 and 3 lose nothing.

Full sets are fetched for confirmed pairs only, in groups of a few MB that get each set once; hubs with many partners
are in several groups. What is broadcast are ids, labels or counts where their counted rows are few.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; a text of fewer
words than a shingle has one, the whole; rows with a null id have no component and are kept; rows of one id
are one document, linked with whatever one of its texts is alike; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .common import BROADCAST_KEYS, drop, is_small, lookup, settle, small_batches
from .graph import components

PERCENT = 80
SKETCH = 64
FLOOR = 0.5
#: Lists up to this size pair their documents directly, longer ones by their edits of a hub; both lose no link.
SHORT = 16
#: Bytes of full sets in a group of pairs, about.
GROUP = 8 << 20
_WHOLE = 1 << 31


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of each text, in order of number and hash."""
    h, doc = arrays.word_hashes(texts)
    s, d, _ = arrays.windows(h, doc, k)
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < k))
    if short.size:
        start = np.cumsum(count) - count
        with np.errstate(over="ignore"):
            whole = count[short].astype(np.uint64)
            for j in range(k - 1):
                has = count[short] > j
                whole = whole + np.where(has, h[np.minimum(start[short] + j, len(h) - 1)] * arrays.PLACES[32 + j], np.uint64(0))
            s, d = np.concatenate((s, arrays.mix(whole))), np.concatenate((d, short))
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))[: len(s)]
    return s[new], d[new]


def _signs(docs: DataFrame, k: int, sketch: int) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (fingerprint of the set) and sketch (its smallest hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrays.small(batches, 1):
            s, d = shingles(arrays.as_bytes(b.column(1)), k)
            n = np.bincount(d, minlength=b.num_rows)
            stop = np.concatenate(([0], np.cumsum(n)))
            with np.errstate(over="ignore"):
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(arrays.mix(s * np.uint64(c))))) for c in (1, 0x9E3779B97F4A7C15)]
                f1, f2 = ((x[stop[1:]] - x[stop[:-1]]).view(np.int64) for x in sums)
            low = s[np.arange(len(s)) - stop[d] < sketch].view(np.int64)
            places = np.concatenate(([0], np.cumsum(np.minimum(n, sketch)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(pa.array(places), pa.array(low))], ["doc_id", "n", "f1", "f2", "sketch"])

    return settle(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sketch array<long>"), "signs")


def _entries(heads: DataFrame, sketch: int) -> DataFrame:
    """(value, doc, n, listed): the inverted lists, with each document's set size and number of values listed."""
    each = heads.select("doc_id", "n", "f1", F.explode("sketch").alias("value"))
    # Equal rows hold a value twice, but in one document.
    counts = each.groupBy("value").agg(F.count("*").alias("df"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = settle(counts.where("lo < hi").select("value", "df"), "shared")
    live = each.join(shared, "value")  # it grows with the documents, so it is not broadcast
    size = F.least("n", F.lit(sketch))
    # Where partners of any size within the limit have whole sketches the overlap is sure.
    need = F.when(100 * F.col("n") <= PERCENT * sketch, F.ceil(PERCENT * F.col("n") / 100)).otherwise(-(-sketch // 2))
    own = live.groupBy("doc_id", "f1", "n").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("v"))  # at most ``sketch`` values
    first = F.greatest(size - need + 1 - (size - F.size("v")), F.lit(0)).cast("int")
    own = own.withColumn("listed", F.least(first, F.size("v"))).where("listed > 0")
    out = own.select(F.explode(F.slice("v", F.lit(1), F.col("listed"))).alias("v"), F.col("doc_id").alias("doc"), "n", "listed")
    out = settle(out.select("v.value", "doc", "n", "listed"), "entries")
    drop(heads.sparkSession, shared)
    return out


def _sizes_allow(m, n):
    return 100 * F.least(m, n) >= PERCENT * F.greatest(m, n)


def _hub():
    """The document of a list with the most values listed, the smallest id of equals."""
    return F.max_by(F.struct(F.col("doc").alias("hub"), F.col("n").alias("hub_n")), F.struct("listed", -F.col("doc"))).alias("h")


def _of(df: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose doc_id is in ``pairs``, and the table of these ids."""
    ids = settle(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "ids")
    return df.join(F.broadcast(ids) if is_small(ids, BROADCAST_KEYS) else ids, "doc_id", "left_semi"), ids


def _likely(pairs: DataFrame, heads: DataFrame, sketch: int) -> DataFrame:
    """The pairs (a, b, m, n) whose union sketch does not rule a link out."""
    pairs = settle(pairs, "pairs")
    some, ids = _of(heads.select("doc_id", "sketch"), pairs)
    with_a = pairs.join(some, F.col("a") == F.col("doc_id")).select(*pairs.columns, F.col("sketch").alias("x"))
    both = with_a.join(some, F.col("b") == F.col("doc_id")).select(*pairs.columns, "x", F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for c in (b.column(4), b.column(5)):
                flat, stop = c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy() - c.offsets[0].as_py()
                sets.append([flat[i:j] for i, j in zip(stop[:-1], stop[1:])])
            keep = []
            for x, y in zip(*sets):
                every = np.concatenate((x, y))
                every.sort()
                twice = np.append(every[1:] == every[:-1], False)
                new = np.append(True, ~twice[:-1])
                union = np.flatnonzero(new)[:sketch]
                keep.append(int(np.count_nonzero(twice[union])) >= FLOOR * len(union))
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "b", "m", "n"]).filter(pa.array(keep, pa.bool_()))

    out = settle(both.mapInArrow(run, "a long, b long, m long, n long").dropDuplicates(["a", "b"]), "likely")
    for df in (pairs, ids):
        drop(heads.sparkSession, df)
    return out


def _with_sets(pairs: DataFrame, docs: DataFrame, k: int, compare, kind: str, name: str) -> DataFrame:
    """What ``compare`` makes of groups of pairs (a, b) of document ids: it gets the full sets of a group by id, and
    its pairs. ``pairs`` is settled and has the set sizes m and n."""
    spark = docs.sparkSession
    some, ids = _of(docs, pairs)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrays.small(batches, 1):
            s, d = shingles(arrays.as_bytes(b.column(1)), k)
            stop = np.cumsum(np.bincount(d, minlength=b.num_rows))
            data = [x.tobytes() for x in np.split(s, stop[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    full = some.select("doc_id", "text").mapInArrow(sets, "doc_id long, data binary")
    total = pairs.agg(F.sum(8 * (F.col("m") + F.col("n")))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // GROUP))
    # A document with very many partners meets them in many groups.
    hubs = pairs.groupBy("a").agg(F.ceil(F.sum(8 * F.col("n")) / (GROUP // 2)).alias("salts")).where("salts > 1")
    salted = lookup(pairs.select("a", "b"), settle(hubs, "hubs"), ["a"], "b")
    g = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))), F.lit(groups)).cast("int")
    salted = settle(salted.select(g.alias("g"), "a", "b"), "grouped")
    wanted = salted.select("g", F.col("a").alias("doc")).unionAll(salted.select("g", "b")).distinct()
    left = wanted.join(full, F.col("doc") == F.col("doc_id")).select(F.col("g").alias("of"), "doc", "data")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own: dict[int, list[np.ndarray]] = {}
        for a, x in sorted(zip(left["doc"].to_pylist(), left["data"].to_pylist())):
            own.setdefault(a, []).append(np.frombuffer(x, np.uint64))
        return compare(own, sorted(zip(right["a"].to_pylist(), right["b"].to_pylist())))

    found = settle(left.groupBy("of").cogroup(salted.groupBy("g")).applyInArrow(run, kind), name)
    for df in (ids, salted):
        drop(spark, df)
    return found


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same > 0 and 100 * same >= PERCENT * (len(both) - same)


def _confirm(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets are alike enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(own, pairs) -> pa.Table:
        linked = [(a, b) for a, b in pairs if any(_alike(x, y) for x in own.get(a, ()) for y in own.get(b, ()))]
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in linked], schema=schema)

    return _with_sets(pairs, docs, k, compare, "a long, b long", "links")


def _edits(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """How each document b differs from its hub a: n (set size), gone and more (numbers of the hub's
    shingles that it lacks, and of its own), loose (not alike the hub's first set),
    extra (its own) and few (the lacked ones), each in order and as many as :func:`_off_hub` needs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((c, pa.int64()) for c in ("n", "gone", "more")), ("loose", pa.bool_()), ("extra", pa.list_(pa.int64())), ("few", pa.list_(pa.int64()))])

    def compare(own, pairs) -> pa.Table:
        out = []
        for a, b in pairs:
            hub = own[a][0]
            for y in own[b]:
                lacked, extra = np.setdiff1d(hub, y, True), np.setdiff1d(y, hub, True)
                n, gone, more = len(y), len(lacked), len(extra)
                loose = 9 * (gone + more) > n + len(hub)
                few = n // 4 + 1 - more if loose else (4 * (gone - more)) // 9 + 1
                extra = extra[: n // 4 + 1] if loose else extra
                out.append({"a": a, "b": b, "n": n, "gone": gone, "more": more, "loose": loose, "extra": extra.view(np.int64), "few": lacked[: max(0, few)].view(np.int64)})
        return pa.Table.from_pylist(out, schema=schema)

    return _with_sets(pairs, docs, k, compare, "a long, b long, n long, gone long, more long, loose boolean, extra array<long>, few array<long>", "edits")


def _off_hub(edits: DataFrame) -> DataFrame:
    """The pairs (a, b, m, n) of documents with one hub that may be linked though one of them is not alike the hub.

    Let D be a document's edits, what it lacks of the hub and what it has besides. Two sets of sizes m and n
    are alike if their edits differ by (m + n) / 9 at most (for 80 percent), so they share at least
    (|D| + |D'| - (m + n) / 9) / 2 edits, which is over 0. Either they share something that the hub has not,
    or their share of the lacked shingles alone reaches that number, and then the first few lacked ones of
    both meet (a prefix filter). A loose document has n / 4 more edits than it has to share at most, so in
    an order with its own shingles first the first n / 4 + 1 edits are enough to meet. Edits of single documents are
    shared with none, which bounds the rest. ``edits`` has ``label``, the component of b so far.
    """
    own = edits.select("a", "b", "label", F.explode("extra").alias("edit"))  # those left out may all be shared
    shared = settle(own.groupBy("a", "edit").agg(F.count("*").alias("c"), (F.min("label") < F.max("label")).alias("mixed")).where("c > 1").drop("c"), "shared")
    common = own.join(shared, ["a", "edit"])
    both = common.groupBy("a", "b").agg(F.count("*").alias("common"))
    rest = F.col("more") - F.size("extra")
    info = edits.select("a", "b", "n", "gone", "more", "loose", "label", rest.alias("rest")).join(both, ["a", "b"], "left")
    info = settle(info.fillna(0, ["common"]), "info")
    keys = common.where("mixed").select("a", "b", "edit", F.lit(True).alias("own")).unionByName(edits.select("a", "b", F.explode("few").alias("edit"), F.lit(False).alias("own")))
    x = settle(keys.join(info, ["a", "b"]), "keys")
    y = x.select(*[F.col(c).alias(f"{c}_2") for c in x.columns])
    needed = 9 * (F.col("gone") + F.col("more") + F.col("gone_2") + F.col("more_2")) - (F.col("n") + F.col("n_2"))
    reached = F.least("gone", "gone_2") + F.when(F.col("own"), F.least("common", "common_2") + F.col("rest") + F.col("rest_2")).otherwise(0)
    may = (F.col("b") < F.col("b_2")) & (F.col("label") != F.col("label_2")) & (F.col("loose") | F.col("loose_2")) & (needed <= 18 * reached)
    may = may & _sizes_allow(F.col("n"), F.col("n_2"))
    same = [F.col(c) == F.col(f"{c}_2") for c in ("a", "edit", "own")]
    return x.join(y, [*same, may]).select(F.col("b").alias("a"), F.col("b_2").alias("b"), F.col("n").alias("m"), F.col("n_2").alias("n"))


def _spokes(entries: DataFrame, lists: DataFrame, *more: str) -> DataFrame:
    """Rows (a = hub, b = document, m, n) of the documents of each list, a row for each list."""
    met = entries.join(lists, "value").where("doc <> hub")
    return met.select(F.col("hub").alias("a"), F.col("doc").alias("b"), F.col("hub_n").alias("m"), "n", *more)


def near_duplicates(docs: DataFrame, k: int, sketch: int | None = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that a document reaches) and kept, a row for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    sketch = sketch or _WHOLE
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signs = _signs(docs, k, sketch)
    solid = signs.where("n > 0 AND doc_id IS NOT NULL")
    classes = settle(solid.groupBy("f1", "f2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m")).where("m > 1").drop("m"), "classes")
    rows = lookup(signs.select("doc_id", "n", "f1", "f2"), classes, ["f1", "f2"], "doc_id")
    rows = settle(rows.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("first_id", "doc_id")).otherwise(F.col("doc_id")).alias("first_id")), "rows")
    by_id = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("first_id").alias("lo"), F.max("first_id").alias("hi"))
    by_id = settle(by_id.where("lo < hi OR hi < doc_id"), "by_id")
    copies = by_id.where("hi < doc_id").select("doc_id")  # all rows of the id are copies
    several = rows.join(by_id.where("lo < hi").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")).where("b IS NOT NULL")
    first_of = lambda df: df.join(F.broadcast(copies) if is_small(copies, BROADCAST_KEYS) else copies, "doc_id", "left_anti")
    firsts, heads = first_of(docs.where("doc_id IS NOT NULL")), first_of(solid)

    entries = _entries(heads, sketch)
    lists = entries.groupBy("value").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), _hub()).where("lo < hi").select("value", "h.*")
    near = _spokes(entries, settle(lists, "lists")).where(_sizes_allow(F.col("m"), F.col("n")))
    overlaps = near.groupBy("a", "b", "m", "n").agg(F.count("*").alias("overlap"))
    best = overlaps.groupBy("b").agg(F.max_by(F.struct("a", "m", "n"), F.struct("overlap", -F.col("a"))).alias("p")).select("p.a", "b", "p.m", "p.n")
    stars = _likely(best, heads, sketch)
    links = _confirm(stars, firsts, k).unionAll(several)
    labels = components(links)

    marked = lookup(entries, labels.withColumnRenamed("node", "doc"), ["doc"], "value").withColumn("label", F.coalesce("label", "doc"))
    marked = settle(marked, "labelled")
    drop(spark, entries)
    mixed = marked.groupBy("value").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), _hub()).where("lo <> hi")
    mixed = settle(mixed.select("value", F.col("m").alias("size"), "h.*"), "mixed")
    short = marked.join(mixed.where(F.col("size") <= SHORT).select("value"), "value").select("value", "doc", "n", "label")
    other = short.select("value", F.col("doc").alias("b"), F.col("n").alias("n_2"), F.col("label").alias("label_2"))
    fits = (F.col("doc") < F.col("b")) & (F.col("label") != F.col("label_2")) & _sizes_allow(F.col("n"), F.col("n_2"))
    pairs = short.join(other, (short["value"] == other["value"]) & fits).select(F.col("doc").alias("a"), "b", F.col("n").alias("m"), F.col("n_2").alias("n"))
    spokes = settle(_spokes(marked, mixed.where(F.col("size") > SHORT), "label").dropDuplicates(["a", "b"]), "spokes")
    edits = _edits(spokes, firsts, k).join(spokes.select("a", "b", "m", "label"), ["a", "b"])
    edits = settle(edits, "edits")
    hubs = edits.where("NOT loose").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m", "n")
    pairs = pairs.unionByName(_off_hub(edits.drop("m"))).unionByName(hubs).dropDuplicates(["a", "b"])
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _confirm(_likely(pairs.join(done, ["a", "b"], "left_anti"), heads, sketch), firsts, k)
    labels = components(links.unionAll(more)).select(F.col("node").alias("first_id"), "label")
    for df in (marked, mixed, spokes, edits, signs):
        drop(spark, df)
    part = F.coalesce("label", "first_id")
    return lookup(rows, labels, ["first_id"], "doc_id").select("doc_id", F.col("n").alias("n_shingles"), part.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == part)).alias("kept"))


def keep(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all their columns."""
    gone = settle(near_duplicates(docs, k).where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if is_small(gone, BROADCAST_KEYS) else gone, "doc_id", "left_anti").select(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
