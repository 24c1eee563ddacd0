import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from longview.llm import arrays, common, decontaminate, pieces

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
CODEC = pieces.Codec(MODEL)


def brute_score(text):
    """The best sum of scores over all ways to cut a text, place by place."""
    s = (" " + text.replace(pieces.SPACE, "\x00")).replace(" ", pieces.SPACE)
    best = [0.0] + [-np.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 20), j):
            if s[i:j] in CODEC.scores:
                best[j] = max(best[j], best[i] + CODEC.scores[s[i:j]][1])
        c = s[j - 1]
        if c not in CODEC.scores:
            best[j] = max(best[j], best[j - 1] + CODEC.byte_score * len((pieces.SPACE if c == "\x00" else c).encode()))
    return best[-1]


def score_of(ids):
    of = {i: s for _, s, i in CODEC.scores.values()}
    return sum(of.get(i, CODEC.byte_score) for i in ids.tolist())


texts = st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["the  quick\n\n brown", " ", "\n", "▁", "\x00", "日本語 the", "naïve ", "   aaaa"])), max_size=5).map("".join)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_viterbi_and_round_trip(text):
    ids = CODEC.encode(text)
    assert CODEC.decode(ids) == text.encode()
    if text and "\x00" not in text:
        assert score_of(ids) == pytest.approx(brute_score(text))
    assert (CODEC.encode(text) == ids).all()


def test_encode_query(spark):
    rows = __import__("longview.llm.pieces", fromlist=["op5"]).op5(spark, SF).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows) and all(len(r.ids) == r.n_tokens for r in rows)


def test_encode_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "word " * 50_000, None), (3, "word " * 50_000, None)], "doc_id long, text string, n string")
    rows = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in rows) == [(1, ""), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000)]
    assert pieces.encode(df.limit(0), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), MODEL).count() == 2


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_bpe_ids_are_the_librarys(text):
    text = text.replace(pieces.SPACE, " ")
    codec = pieces.codec(MODEL)
    assert codec.encode(text).tolist() == LIBRARY.encode(text)
    if text and "\x00" not in text:  # which stands for U+2581 inside a part
        assert codec.part((" " + text).replace(" ", pieces.SPACE)) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([p for p in CODEC.scores if "\u2581" not in p]), min_size=1, max_size=8).map("".join))
def test_bpe_ids_of_joined_pieces_are_the_librarys(text):
    assert pieces.codec(MODEL).encode(text).tolist() == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["word", "Wort", "x2", "²", "don't", "e.g", "日本", "a\n", "..", ""]), st.sampled_from(["", ".", ",", "...", "!?", "$$$", ")", "'s", "\n"])), max_size=30))
def test_words_with_punctuation_have_the_librarys_ids(words):
    # A word that is known lends its ids to the same word with punctuation.
    text = " ".join(w + p for w, p in words)
    codec = pieces.codec(MODEL)
    assert codec.encode(" ".join(w for w, _ in words)).tolist() == LIBRARY.encode(" ".join(w for w, _ in words))
    assert codec.encode(text).tolist() == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(*[st.sampled_from([p for p in CODEC.scores if "\u2581" not in p])] * 2)
def test_pieces_fit_where_the_library_keeps_them(a, b):
    codec, found = pieces.codec(MODEL), LIBRARY.encode("\n" + a + b, out_type=str)  # merged with no line feed
    assert codec.fits(a, b) == (found[-2:] == [a, b])


def test_encoding_leaves_other_columns(spark):
    df = spark.createDataFrame([(1, "Hello  world", "a", "b", "c", "d", 5)], "doc_id long, text string, ids string, n_tokens string, decoded string, round_trip string, k int")
    r = pieces.verified(df, MODEL).collect()[0]
    assert r.asDict().keys() == {"doc_id", "text", "decoded", "k", "ids", "n_tokens", "decoded_sha256", "round_trip"}
    assert r.ids == LIBRARY.encode("Hello  world") and r.n_tokens == len(r.ids) and r.round_trip and r.decoded == "c"
    assert pieces.decode(pieces.encode(df, MODEL), MODEL).collect()[0].decoded == b"Hello  world"


def test_encode_query_has_the_librarys_ids(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op5(spark, SF).collect():
        assert r.ids == LIBRARY.encode(docs[r.doc_id] or ""), r.doc_id
    for text in ("Hello world", "a" * 5000, "the" * 3000, " " * 999 + "x", "a\x00b", "\x00 a", "naïve 日本語\n\n  x\n", "aé" * 300):
        assert pieces.codec(MODEL).encode(text).tolist() == LIBRARY.encode(text), text[:20]


# --- words and decontamination
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB \n\té0"), max_size=40), max_size=6))
def test_word_hashes(texts):
    h, d = arrays.word_hashes([t.encode() for t in texts])
    words = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for i, t in enumerate(texts) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    assert d.tolist() == [i for i, _ in words]
    seen = {}
    for (_, w), x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = b"some words here " * 500 + b"z" * 3000 + b" end"
    whole = arrays.word_hashes([text, b"x y"])
    monkeypatch.setattr(arrays, "PIECE", 1000)
    cut = arrays.word_hashes([text, b"x y"])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


ITEMS = [(7, "A train leaves Boston at 60 km per hour and Alice waits 3 hours for the train to Boston with Bob."), (8, "what is two plus two"), (9, None), (10, "one two three"), (7, "An unrelated question about the colour of the northern sky tonight")]


def canonical(text):
    """(word, kind) of each token of a text, kind being "", "number", "name" or "unit"."""
    out, after = [], True
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        if "\n" in text[out[-1][2] if out else 0 : m.start()]:
            after = True
        w = m[0]
        bare = "".join(c.lower() if ord(c) < 128 else c for c in w if ord(c) > 127 or c.isalnum())
        if bare:
            lead = next(c for c in w if ord(c) > 127 or c.isalnum())
            name = lead in string.ascii_uppercase or "À" <= lead <= "Þ"
            kind = "number" if lead in string.digits else "name" if name and not after else ""
            if bare in decontaminate.UNITS and out and out[-1][1] == "number":
                kind = "unit"
            out.append((bare, kind, m.end()))
        after = w[-1] in ".!?:;"
        if not bare and out:
            out[-1] = (*out[-1][:2], m.end()) if "\n" not in text[out[-1][2] : m.start()] else out[-1]
    return [(w, k) for w, k, _ in out]


def counts(x, y):
    """Whether a window x of a text counts as the window y of an item."""
    if [w for w, _ in x] == [w for w, _ in y]:
        return True
    plain = sum(not k for _, k in y)
    if [k for _, k in x] != [k for _, k in y] or plain < decontaminate.LITERALS or plain == len(y):
        return False
    stands = {}
    return all(stands.setdefault((k, v), w) == w if k else v == w for (w, _), (v, k) in zip(x, y))


def brute(text, items):
    """(item ids, tokens of the text in windows that count), every window compared with every one."""
    t, ids, covered = canonical(text), [], set()
    for i, item in items:
        y = canonical(item)
        k = min(len(y), decontaminate.WINDOW)
        hit = [a for a in range(len(t) - k + 1) if k >= decontaminate.SHORTEST and any(counts(t[a : a + k], y[b : b + k]) for b in range(len(y) - k + 1))]
        ids += [i] if hit else []
        covered.update(a + j for a in hit for j in range(k))
    return ids, len(covered)


def check(spark, texts, items):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.n_matched) for r in decontaminate.matches(docs, bench).collect()}
    for i, t in enumerate(texts):
        ids, n = brute(t, items)
        assert (sorted(got[i][0], key=str), got[i][1]) == (sorted(ids, key=str), n), t
    return [got[i] for i in range(len(texts))]


def test_reparameterised_questions(spark):
    got = check(spark, [
        "Some text. a train leaves Denver at 75 miles per hour and Carol waits 9 hours for the train to Denver with Dan. More.",
        # Denver and Boulder stand for one name of the item: no window holds both.
        "it said: the train leaves Denver at 75 km per hour and Carol waits 9 hours for the train to Boulder with Dan",
        "WHAT is two, plus two!", "what is two plus three", "one two three", "An unrelated question about the colour of grass",
        "an UNRELATED question about the colour of the northern sky tonight", "", None,
    ], ITEMS)
    assert [ids for ids, _ in got] == [[7], [7], [8], [], [], [], [7], [], []]


def test_slots_are_judged_window_by_window(spark):
    item = "the old bridge near Lima was built by 40 men who had walked there from far away and were paid in silver before the town of Lima had its own walls and towers again today"
    table = "3 km 4 km 5 km 6 km 7 km 8 km"
    passage = "the train from Lima met Anna and Bert at noon near Quito where Carl slept"
    items = [(1, item), (2, "so Ann owes Ann 7 coins and Ann pays"), (3, table), (4, passage), (5, "add 3 apples to 5 apples in the basket"), (6, "2 4 6 8"), (6, "2 4 6 8"), (None, "give 5 pears to 5 men here now")]
    got = check(spark, [
        "so " + item.replace("town of Lima", "town of Cusco") + " ok", "so " + item,
        "so Eve owes Eve 8 coins and Eve pays", "so Eve owes Tom 8 coins and Eve pays", "so eve owes eve 8 coins and eve pays",
        f"see {table} here", "see 9 km 4 km 2 km 6 km 1 km 8 km here",
        "AND " + passage.upper() + " SO", "and " + passage.lower() + " so",
        "add 4 apples to 4 apples in the basket", "give 6 pears to 7 men here now", "give 6 pears to 6 men here now", "it is 2 4 6 8 again",
    ], items)
    assert [ids for ids, _ in got] == [[1], [1], [2], [], [], [3], [], [4], [4], [5], [], [None], [6, 6]]
    assert got[1][1] == len(item.split())


def test_random_texts_match_brute_force(spark):
    r = random.Random(3)
    pool = ["Ann", "Bob", "3", "7", "km", "the", "cat", "sat", "on", "mat.", "and", "ran", "(far)", "--", "off\n", "É", "hours"]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.randint(3, 25))) for i in range(60)]
    texts = [text(r.randint(0, 60)) for _ in range(40)]
    for _ in range(60):  # copies with other names and numbers
        x = r.choice(items)[1]
        for a, b in r.sample([("Ann", "Eve"), ("Bob", "Tom"), ("3", "5"), ("7", "3"), ("Ann", "Bob"), ("cat", "dog")], 2):
            x = x.replace(a, b)
        texts.append(f"{text(3)} {x} {text(3)}")
    got = check(spark, texts, items)
    assert sum(bool(ids) for ids, _ in got) > 30


def test_decontamination_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = decontaminate.op2(spark, SF).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    wanted = {w for _, t in items for w, k in canonical(t) if not k}
    for r in rows:
        near = sum(w in wanted for w, _ in canonical(docs[r.doc_id])) >= 4  # else no window can count
        ids, n = brute(docs[r.doc_id], items) if near and (r.contaminated or r.doc_id % 5 == 0) else ([], 0)
        if r.contaminated or r.doc_id % 5 == 0:
            assert (sorted(map(int, filter(None, r.item_ids.split(",")))), r.n_items, r.n_matched) == (sorted(ids), len(ids), n), r.doc_id


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_cases(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(common, "is_small", lambda *_: False)
        monkeypatch.setattr(decontaminate, "is_small", lambda *_: False)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "and what is two plus two", 0), (3, "and what is two plus two", 0), (None, "filler " * 300_000 + ITEMS[0][1], 1)], "doc_id long, text string, n_matched int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda df: sorted(((r.doc_id, sorted(r.item_ids)) for r in df.collect()), key=str)
    want = sorted([(1, []), (2, []), (3, [8]), (3, [8]), (None, [7])], key=str)
    assert key(decontaminate.matches(docs, bench)) == want
    assert sorted((r.doc_id, r.n_matched) for r in decontaminate.keep(docs, bench).collect()) == [(1, 0), (2, 0)]
    assert key(decontaminate.matches(docs, bench.limit(0))) == [(k, []) for k, _ in want]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
