import math
import re
import zlib
from collections import Counter

import pytest

from longview.llm import lm

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def toks(t):
    return [*(w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")), None]


class Automaton:
    """The automaton held in memory: arcs of the n-grams seen, and failure arcs."""

    def __init__(self, train):
        self.one, self.two, self.three, self.after1, self.after2 = (Counter() for _ in range(5))
        for t in train:
            u, v = None, "<begin>"
            for w in t:
                self.one[w] += 1
                self.two[v, w] += 1
                self.after1[v] += 1
                if v != "<begin>":
                    self.three[u, v, w] += 1
                    self.after2[u, v] += 1
                u, v = v, (w,)
        self.n, self.v = sum(self.one.values()), len(self.one)

    def weight(self, state, w):
        """Of the arc for ``w`` from a state, or of the failure arc and what follows."""
        if state == ():
            return (self.one[w] + 1) / (self.n + self.v + 1)
        seen, left, k = (self.two, self.after1[state[0]], lm.BIGRAM) if len(state) == 1 else (self.three, self.after2[state], lm.TRIGRAM)
        fail = k / (left + k)
        return seen[(*state, w)] / (left + k) + fail * self.weight(state[1:], w)

    def score(self, t):
        total, state = 0.0, ("<begin>",)
        for w in t:
            total += math.log10(self.weight(state, w))
            state = (*state, (w,))[-2:]
        return total


def brute(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    m = Automaton([toks(t) for (_, t), h in zip(rows, held) if not h])
    out = []
    for (i, t), h in zip(rows, held):
        x = toks(t)
        out.append((i, h, len(x), sum(m.one[w] > 0 for w in x), m.n, sum(math.log10(m.weight((), w)) for w in x), m.score(x)))
    return out


def check(got, rows):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6), round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_query_matches_brute_force_and_beats_base(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = lm.op10(spark, SF).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize(("shared", "hot"), [(4, 2), (1 << 18, 2), (1 << 18, 30), (1 << 18, 8192), (0, 8192), (20, 50)])
def test_cases(spark, monkeypatch, shared, hot):
    monkeypatch.setattr(lm, "SHARED", shared)
    monkeypatch.setattr(lm, "HOT", hot)
    rows = [(i, "a b A c " * (i % 4) + f"x{i}") for i in range(40)] + [(None, "a b"), (None, None), (5, ""), (5, ""), (6, "\n é \t"), (7, "a b " * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    check(lm.score(df).collect(), rows)


@pytest.mark.parametrize("shared", [0, 1, 4, 60])
def test_cold_words_have_their_own_arcs(spark, monkeypatch, shared):
    monkeypatch.setattr(lm, "SHARED", shared)
    rows = [(i, "a b A c " * (i % 4) + f"x{i % 9} y{i % 3} x{i % 9} x1") for i in range(60)] + [(None, "a b"), (None, None), (5, ""), (6, "\n x1 y2 \t"), (7, "x1 y1 new " * 3_000)]
    check(lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_every_ngram_is_a_state_whatever_the_size(spark):
    rows = [(i, " ".join(f"w{(i * 7919 + j * j) % 60_000} a b" for j in range(300))) for i in range(400)] + [(None, "w1 w2 zz w3"), (None, None)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got[0].train_tokens > 1 << 18
    check(got, rows)


def test_weights_of_a_state_sum_to_one():
    # With the one type that stands for all unknown words.
    m = Automaton([toks(t) for t in ("a b c", "a b d", "b c", "", "a a a b")])
    words = [*m.one, "unknown"]
    for state in [(), ("<begin>",), (("a",),), (("c",),), (("a",), ("b",)), ("<begin>", ("a",)), (("d",), ("a",))]:
        assert sum(m.weight(state, w) for w in words) == pytest.approx(1)


def test_no_training_rows_and_empty_table(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(i, "a b")], "doc_id long, text string")
    check(lm.score(df).collect(), [(i, "a b")])
    assert lm.score(df.limit(0)).count() == 0


def test_events_are_packed_whole():
    import numpy as np
    import pyarrow as pa

    uid = np.array([5, 5, 6, 70_000, 70_000, 1 << 35, (1 << 35) + 65_535])
    u = np.array([0, 65_536, 262_144, (1 << 63) + 5, 3, (1 << 63) + (1 << 62), 77], np.uint64)
    rows = list(lm._packed(lm.PAIR, np.zeros(7, int), uid, np.arange(7), np.arange(7), u))
    table = pa.Table.from_pylist(rows, schema=lm._EVENT_SCHEMA)
    numbers, docs = lm._rows_of(table)
    assert numbers[docs].tolist() == uid.tolist() and lm._codes(table).tolist() == u.tolist()
