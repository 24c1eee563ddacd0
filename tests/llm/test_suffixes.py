import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from longview.llm import arrays, common, suffixes

SF = "/root/testdata/sf0.001"
L = suffixes.LENGTH


def brute(docs):
    """(id, bytes) rows -> sorted (id, n_bytes, n_removed, n_spans, sha256)."""
    first = {}
    for i, t in docs:
        for a in range(len(t) - L + 1) if i is not None else ():
            first[t[a : a + L]] = min(first.get(t[a : a + L], i), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - L + 1) if i is not None else ():
            if first[t[a : a + L]] < i:
                gone[a : a + L] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2] if len(t) > 1 else [])[: len(t)]).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id if "doc_id" in r else r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


segments = st.lists(st.tuples(st.integers(1, 30), st.integers(0, 2**32)), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(segments, st.sampled_from([1, 3, 8, 9, 16, 20, L]), st.booleans())
def test_suffix_array_and_common_prefixes(segments, depth, twice):
    texts = [bytes(random.Random(seed).choices(b"ab", k=depth - 1 + n)) for n, seed in segments]
    texts += texts[:2] if twice else []
    size = np.array([len(t) for t in texts])
    start, count = np.cumsum(size) - size, size - depth + 1
    eights = suffixes._eights(np.frombuffer(b"".join(texts), np.uint8))
    windows = [t[i : i + depth] for t in texts for i in range(len(t) - depth + 1)]
    order = suffixes.suffix_array(eights, start, count, depth)
    found = [windows[i] for i in order]
    assert found == sorted(windows) and sorted(order.tolist()) == list(range(len(windows)))
    common = suffixes.kasai(eights, start, count, order, depth)
    for k in range(1, len(found)):
        assert common[k] == next((i for i, (a, b) in enumerate(zip(found[k - 1], found[k])) if a != b), depth)


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(suffixes.op9(spark, SF)) == brute(docs)


def planted(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    rows = [(i, text(r.randint(0, 60)) + (passage[r.randint(0, 30) :] if r.random() < 0.5 else "") + text(5)) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(20)] + [(50, "ab" * 400), (51, "ab" * 300), (52, "x" * L), (53, "x" * (L - 1)), (54, "x" * 300)]
    return rows + [(None, passage), (None, None), (60, None), (60, ""), (61, passage), (61, passage), (-5, passage + "q")]


def test_planted_cases_and_bounds(spark, monkeypatch):
    rows = planted(1)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_bytes int, key string")
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert got(suffixes.remove(df)) == want
    assert suffixes.remove(df.limit(0)).count() == 0
    assert got(suffixes.remove(df.where("doc_id is null"))) == [x for x in want if x[0] is None]


def test_windows_of_hot_anchors_lose_nothing(spark, monkeypatch):
    rows = planted(3)
    phrase = "a phrase of forty bytes that is everywhere"
    rows += [(200 + i, f"{i * 7919} {phrase} {i % 3 * 104729} and more") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(i, (t or "").encode()) for i, t in rows])
    for hot in (2, 25):
        monkeypatch.setattr(suffixes, "HOT", hot)
        assert got(suffixes.remove(df)) == want


def test_shards_pieces_and_shuffled_joins(spark, monkeypatch):
    import longview.llm.suffixes as m

    rows = [(i, t) for i, t in planted(2) if i is not None]
    text = [(t or "").encode() for _, t in rows]
    # many shards
    ids = np.array([(i, k) for k, (i, _) in enumerate(rows)])
    sizes = np.array([len(t) for t in text])
    ok = np.flatnonzero(sizes >= L)
    segments = (np.frombuffer(b"".join(text[i] for i in ok), np.uint8), np.cumsum(sizes[ok]) - sizes[ok], sizes[ok] - L + 1)
    whole = m._marks(segments, ids, ok)
    monkeypatch.setattr(m, "SHARD", 300)
    cut = m._marks(segments, ids, ok)
    assert sorted(zip(*map(np.ndarray.tolist, whole))) == sorted(zip(*map(np.ndarray.tolist, cut)))
    # long texts in overlapping pieces give the same windows
    collect = lambda: sorted((int(d), int(o) + k, int(h)) for _, _, c, h, of, off in m._runs_of(text) for d, o, n, h in zip(of, off, c, h) for k in range(n))
    a = collect()
    monkeypatch.setattr(arrays, "PIECE", 200)
    assert collect() == a
    # the joins without broadcast
    monkeypatch.setattr(m, "is_small", lambda *_: False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(m.remove(df)) == brute([(i, (t or "").encode()) for i, t in rows])


def test_work_of_shards_follows_their_number(monkeypatch):
    r = random.Random(4)
    text = [bytes(r.choices(b"abc", k=L + r.randint(0, 13))) for _ in range(3000)]
    text += [text[r.randint(0, 99)] for _ in range(3000)]
    size = np.array([len(t) for t in text])
    ids, doc = np.array([(i, i) for i in range(len(text))]), np.arange(len(text))
    segments = (np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size, size - L + 1)
    key = np.array([int.from_bytes(hashlib.sha256(t).digest()[:2]) for t in text])
    whole = suffixes._marks(segments, ids, doc)
    first = {}
    for i, t in enumerate(text):
        for a in range(len(t) - L + 1):
            first.setdefault(t[a : a + L], i)
    assert sorted(zip(*map(np.ndarray.tolist, whole))) == [(i, a) for i, t in enumerate(text) for a in range(len(t) - L + 1) if first[t[a : a + L]] < i]
    monkeypatch.setattr(suffixes, "SHARD", 200)
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    shards = -(-int(segments[2].sum()) // 200)
    for keys in ((), (key,), (np.where(key < 30_000, 0, key),)):  # one key for all, many, one that is too many windows for a shard
        calls.clear()
        cut = suffixes._marks(segments, ids, doc, *keys)
        assert sorted(zip(*map(np.ndarray.tolist, cut))) == sorted(zip(*map(np.ndarray.tolist, whole)))
        assert len(calls) < 40 * shards  # each with each: some 100 times ``shards``


def test_parts_follow_the_size_of_the_table(spark, monkeypatch):
    rows = planted(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "PART", 500, raising=False)
    total = sum(len((t or "").encode()) for i, t in rows if i is not None)
    docs = df.where("doc_id is not null").selectExpr("doc_id", "xxhash64(doc_id, text) key", "coalesce(text, '') text")
    assert suffixes.repeats(docs)[1] == -(-total // 500) > 8
    assert got(suffixes.remove(df)) == brute([(i, (t or "").encode()) for i, t in rows])


def test_a_bucket_takes_the_memory_of_a_shard(monkeypatch):
    import tracemalloc

    r = np.random.default_rng(6)
    text = r.integers(97, 123, (20_000, L + 13), dtype=np.uint8)
    text[15_000:] = text[:5_000]
    key = r.integers(0, 1 << 16, 15_000)
    key = np.concatenate((key, key[:5_000]))
    n = len(text)
    segments = (text.ravel(), np.arange(n) * (L + 13), np.full(n, 14))
    ids, doc = np.stack([np.arange(n)] * 2, 1), np.arange(n)
    monkeypatch.setattr(suffixes, "SHARD", 20_000)
    tracemalloc.start()
    seg, inside = suffixes._marks(segments, ids, doc, key)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(seg.tolist(), inside.tolist())) == [(s, a) for s in range(15_000, n) for a in range(14)]
    assert peak < 14e6  # some 5 MB are a shard's; with the sorted keys of all shards it is over 30
