import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from longview.llm import quality

words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    t = t or ""
    w, lines = words_of(t), [x for x in t.split("\n") if words_of(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def bin_top(x):
    """The largest number with the six leading bits of x."""
    e = max(x.bit_length() - 6, 0)
    return x if x < 64 else (((x >> e) + 1) << e) - 1


def brute(rows):
    """(lang, source, text) rows -> whether each is kept."""
    measured, groups = [], {}
    for lang, source, t in rows:
        n, chars, symbols, dup, rep, lines = base(t)
        m = {"mean_chars": 1000 * chars // n if n else 0, "symbols": 1000 * symbols // n if n else 0, "dup_lines": 1000 * dup // lines if lines else 0, "repeats": 1000 * rep // n if n else 0}
        failed = n < 10 or 100 * rep > 20 * n
        measured.append((lang, source, m, failed))
        if not failed:
            for g in (("own", lang, source), ("lang", lang), ("all",)):
                groups.setdefault(g, []).append(m)

    def fence(group, k, low):
        x = sorted(m[k] for m in groups[group])
        q1, q3 = (bin_top(next(v for i, v in enumerate(x, 1) if 100 * i >= len(x) * p)) for p in (25, 75))
        spread = quality.FENCE * max(q3 - q1, quality.MEASURES[k][1])
        return q1 - spread if low else q3 + spread

    out = []
    for lang, source, m, failed in measured:
        group = next((g for g in (("own", lang, source), ("lang", lang)) if len(groups.get(g, ())) >= quality.MIN_GROUP), ("all",))
        out.append(not failed and all(m[k] <= fence(group, k, False) and (not both or m[k] >= fence(group, k, True)) for k, (_, _, both) in quality.MEASURES.items()))
    return out


texts = st.lists(st.sampled_from(["a", "bb", "c#", "é", "\n", "\t", "x\ny", "<|>", "*"]), max_size=40).map(" ".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_measures(spark, some):
    some = [None, "", "a b c d e " * 3, *some]
    df = spark.createDataFrame([*enumerate(some)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in quality.text_measures(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(some)}


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for i in range(420):
        lang, source = r.choice(["en", "en", None]), r.choice(["hot", "hot", "hot", "cold", None])
        w = ["w" * r.randint(1, 9) + str(r.randrange(10**6)) for _ in range(r.randint(1, 60))]
        kind = r.random()
        if kind < 0.1:
            w = [x + "#$" for x in w]
        elif kind < 0.2:
            w = [*w, *(["again and again it says"] * r.randint(1, 6))]
        elif kind < 0.25:
            w = ["x" * 400] * 20 if kind < 0.22 else [str(j) for j in range(30)]
        rows.append((lang, source, r.choice([" ", "\n"]).join(w)))
    return [*rows, ("en", "hot", None), (None, None, ""), *rows[:3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_fences_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, kept string, n_words int")
    want = brute(rows)
    assert 10 < sum(want) < len(rows) - 10
    assert [r.kept for r in quality.judge(df.drop("kept", "n_words")).orderBy("doc_id").collect()] == want
    assert [r.kept for r in quality.judge(df).orderBy("doc_id").collect()] == want
    kept = quality.keep(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, k in enumerate(want) if k]


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "en", "s", "many different words here " + " ".join(map(str, range(200_000)))), (2, "en", "s", "z" * 500_000)], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: (r.n_words, r.base_failed) for r in quality.judge(df).collect()}
    assert got == {1: (200_004, False), 2: (1, True)}
    assert quality.judge(df.limit(0)).count() == quality.keep(df.limit(0)).count() == 0
