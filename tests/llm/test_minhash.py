import itertools
import random
import re

import pytest

from longview.llm import common, graph, minhash

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def sets(texts, k):
    out = []
    for t in texts:
        w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    return out


def brute(rows, k):
    """(id, text) rows -> {id: (set size, smallest id reached)}, all pairs compared."""
    ids, s = [i for i, _ in rows], sets([t for _, t in rows], k)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, s), 2):
        x = len(a & b)
        if x and 100 * x >= 80 * (len(a) + len(b) - x):
            u, v = sorted((find(i), find(j)))
            root[v] = u
    return {i: (len(x), find(i)) for i, x in zip(ids, s)}


def check(df, rows, k):
    got = df.collect()
    want = brute([r for r in rows if r[0] is not None], k)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(minhash.op3(spark, SF), rows, 4)


def planted(seed):
    """Copies, chains of edits, a passage that most share, near copies of one text, and short texts."""
    r = random.Random(seed)
    text = lambda n, v=400: [f"w{r.randrange(v)}" for _ in range(n)]
    passage, rows = text(12), []
    for _ in range(40):
        rows.append(text(r.randint(3, 60)) + (passage if r.random() < 0.7 else []))
    base = text(60)
    for _ in range(60):  # near copies of one text
        x = base[:]
        for _ in range(r.randint(0, 3)):
            x[r.randrange(60)] = f"e{r.randrange(10**6)}"
        rows.append(x)
    chain = text(50)
    for i in range(12):
        chain = chain[:]
        chain[4 * i] = f"c{i}"
        rows.append(chain)
    rows += [rows[3]] * 20 + [["A", "b"], ["a", "B"], ["a"], ["a", "b", "c", "d"], []]
    r.shuffle(rows)
    return [(i * 7 % 1009, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_cases(spark, seed):
    rows = [*planted(seed), (-1, None), (-2, ""), (-3, " \n\t"), (None, "w1 w2"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, a string")
    check(minhash.near_duplicates(df, 4), rows, 4)
    nulls = [r for r in minhash.near_duplicates(df, 5).collect() if r.doc_id is None]
    assert len(nulls) == 2 and all(r.kept and r.component_id is None for r in nulls)


def family(seed):
    """Texts that differ from one base by words changed, cut off or put in, near the limit of 80 percent and beyond."""
    r = random.Random(seed)
    base, rows = [f"w{r.randrange(300)}" for _ in range(60)], []
    for _ in range(110):
        x = base[:]
        for _ in range(r.randint(0, 5)):
            x[r.randrange(len(x))] = f"e{r.randrange(r.choice((3, 10**6)))}"
        if r.random() < 0.4:
            x = x[r.randint(0, 12) : len(x) - r.randint(0, 12)]
        if r.random() < 0.2:
            at = r.randrange(len(x))
            x[at:at] = [f"i{r.randrange(4)}" for _ in range(r.randint(1, 6))]
        rows.append(x)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize(("seed", "sketch", "group"), [(4, 64, 8 << 20), (5, 64, 4000), (5, None, 8 << 20)])
def test_long_lists_lose_no_link(spark, monkeypatch, seed, sketch, group):
    monkeypatch.setattr(minhash, "SHORT", 2)
    monkeypatch.setattr(minhash, "GROUP", group)  # a small one: hubs are in several groups
    rows = family(seed)
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, sketch), rows, 4)


def near(seed):
    """Texts of several hundred words, their likeness around the limit, so that sketches hold a part of each set only."""
    r = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(150, 600))]
        rows.append(base)
        for _ in range(4):
            x = base[:]
            for at in r.sample(range(len(x)), int(len(x) * r.uniform(0.005, 0.035))):
                x[at] = f"e{r.randrange(10**6)}"
            rows.append(x)
    r.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("seed", [6, 7])
def test_recall_of_sketches(spark, seed):
    # A link is missed by a chance of 2e-8: all are found.
    rows = near(seed)
    s = sets([t for _, t in rows], 4)
    likeness = [len(a & b) / len(a | b) for a, b in itertools.combinations(s, 2)]
    assert sum(0.75 < x < 0.8 for x in likeness) > 5 and sum(0.8 <= x < 0.85 for x in likeness) > 5
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4), rows, 4)


def test_exact_way_and_long_text(spark):
    rows = [*planted(8), (2001, "ab cd ef gh " * 60_000 + "x"), (2002, "ab cd ef gh " * 60_000 + "y"), (2003, "z" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(minhash.near_duplicates(df, 4, None), rows, 4)


def test_rows_of_one_id_are_one_document(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(20))
    rows = [(1, text("a")), (2, text("b")), (3, text("a")), (3, text("b")), (4, text("c")), (4, text("b")), (5, text("c") + " more")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {(i, 1) for i in range(1, 6)}


def exact_pairs(rows, k):
    """The links between texts of ``rows`` that :func:`minhash._off_hub` has to find: not both alike the first."""
    s = sets([t for _, t in rows], k)
    alike = lambda a, b: (x := len(a & b)) > 0 and 100 * x >= 80 * len(a | b)
    loose = [not alike(s[0], x) for x in s]
    return {(i, j) for j in range(1, len(s)) for i in range(1, j) if (loose[i] or loose[j]) and s[i] != s[0] != s[j] and alike(s[i], s[j])}


def test_pairs_by_edits_of_a_hub(spark):
    rows = family(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = len(sets([rows[0][1]], 4)[0])
    spokes = spark.createDataFrame([(0, i, h, h, i) for i in range(1, len(rows))], "a long, b long, m long, n long, label long")
    edits = minhash._edits(spokes, df, 4).join(spokes.select("a", "b", "label"), ["a", "b"])
    got = {(r.a, r.b) for r in minhash._off_hub(edits).collect()}
    want = exact_pairs(rows, 4)
    assert want and want <= got


def test_shuffled_joins_and_small_counts(spark, monkeypatch):
    rows = planted(3)
    monkeypatch.setattr(minhash, "is_small", lambda *_: False)
    monkeypatch.setattr(common, "is_small", lambda *_: False)
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5), rows, 5)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(0, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, 4).collect()) == [(0, 0, True)] + [(1, 0, False)] * 3
    assert minhash.near_duplicates(df.limit(0), 4).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 150: 100}
