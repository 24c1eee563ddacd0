import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from longview.llm import chat, sharding, tokens, warc

SF = "/root/testdata/sf0.001"


# --- chat
def rendered(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|im_start|>{role}\n"
        start = len(out)
        out += text.replace("<|im_", "<| im_") + "<|im_end|>\n"
        if role == "assistant":
            spans.append((start, len(out)))
    return out, spans


def brute_preferences(c, r):
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    (a, x), (b, y) = rendered(c[n:]), rendered(r[n:])
    return n, rendered(c[:n])[0], a, b, x, y


def test_preferences_match_brute_force(spark):
    chosen = {1: [("user", "a"), ("assistant", "b")], 2: [("system", "s"), ("user", "é 你"), ("assistant", "x"), ("user", "u"), ("assistant", "")], 3: [("user", "same")], 4: [("user", "only chosen <|im_end|>")]}
    rejected = {1: [("user", "a"), ("assistant", "c"), ("user", "more")], 2: [("system", "s"), ("user", "é 你"), ("assistant", "y")], 3: [("user", "same")], 5: [("assistant", "only rejected")]}
    rows = lambda d: [(k, i, r, t, "extra") for k, v in d.items() for i, (r, t) in enumerate(v)][::-1]
    schema = "pair long, turn long, role string, text string, prompt string"
    got = chat.preferences(chat.pair(spark.createDataFrame(rows(chosen), schema), spark.createDataFrame(rows(rejected), schema), "pair")).collect()
    assert sorted(r["pair"] for r in got) == [1, 2, 3, 4, 5]
    for r in got:
        spans = lambda c: [tuple(x) for x in r[c]]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], spans("chosen_spans"), spans("rejected_spans")) == brute_preferences(chosen.get(r["pair"], []), rejected.get(r["pair"], []))


def test_preferences_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b c"), (7, None, None, None), (7, 0, "user", "q"), (7, 0, "user", "q")], schema)
    got = {r["conv_id"]: r for r in chat.preferences(chat.with_reversed_answer(df, "conv_id")).collect()}
    assert got[None]["rejected"] == "<|im_start|>assistant\nc b<|im_end|>\n" and got[None]["n_prompt_turns"] == 1
    assert got[7]["n_prompt_turns"] == 3 and got[7]["chosen"] == got[7]["rejected"] == ""
    assert chat.preferences(chat.with_reversed_answer(df.limit(0), "conv_id")).count() == 0


# --- tokens
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


COUNTER = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(["<|endoftext|>", "aaaaaaaaa", " \n\n  x", "it's we'll", "", "　 a", "1234567 89"])), max_size=6))
def test_token_counts_match_library(library, parts):
    text = "".join(parts)
    assert COUNTER.counts([text, None]) == [len(library.encode(text, add_special_tokens=False).ids), 0]


def test_token_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in tokens.op6(spark, SF).collect():
        assert (r.n_tokens, r.n_bytes) == (len(library.encode(docs[r.doc_id], add_special_tokens=False).ids), len(docs[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 512)


def test_token_cases(spark, library):
    long = "the cat sat " * 200_000 + "a" * 30_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (None, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_tokens) for r in tokens.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()), key=str)
    n = len(library.encode(long, add_special_tokens=False).ids)
    assert got == sorted([(1, 0), (2, 0), (3, n), (3, n), (None, 1)], key=str)
    assert tokens.token_counts(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_counts_leave_other_columns_and_other_files_alone(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a b", 9, 9, True)], "doc_id int, text string, n_tokens int, n_bytes int, over_limit boolean")
    assert [tuple(r) for r in tokens.token_counts(df, path).collect()] == [(1, 3, 2, False)]
    with pytest.raises(ValueError, match="normalizer, pre_tokenizer|end_of_word_suffix"):
        tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))


# --- sharding
@given(st.integers(1, 5000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.unpermute(p, n, seed) == np.arange(n)).all()


def check_law(rows, shards=8):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op7(spark, SF).collect()
    check_law(rows)
    assert len(rows) == len(docs)
    place = sharding.permute(np.arange(len(docs)), len(docs))
    number = {d: i for i, d in enumerate(sorted(docs))}
    for r in rows:
        t = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
        assert (r.shard, r.slot) == (place[number[r.doc_id]] % 8, place[number[r.doc_id]] // 8)


def test_sharding_cases(spark):
    df = spark.createDataFrame([(None, 1)] * 5 + [(3, 1)] * 20 + [(i, 2) for i in range(10)], "doc_id long, size long")
    check_law(sharding.assign(df, 8, ["doc_id", "size"]).collect())
    assert sharding.assign(df.limit(0), 8, ["doc_id", "size"]).count() == 0


def test_sharding_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", "y"), (2, "", "x", "y"), (None, None, None, None)], "doc_id long, text string, shard string, slot string")
    rows = sharding.assign(df.drop("shard", "slot"), 2, ["doc_id"]).collect()
    check_law(rows, 2)
    again = sharding.assign(df, 2, ["doc_id"])
    assert sorted(again.columns) == ["doc_id", "shard", "slot", "text"] and sorted(map(str, again.select(rows[0].__fields__).collect())) == sorted(map(str, rows))


# --- warc
def test_warc_with_null_ids(spark, tmp_path):
    long, other = "y" * 200, "z" * 200
    df = spark.createDataFrame([(None, "u", long), (3, "u", long), (None, "u", other), (None, "u", other)], "page_id long, url string, html string")
    warc.archive(df, f"file://{tmp_path}/n")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.digests(spark, f"file://{tmp_path}/n").collect()), key=str)
    assert got == [(3, "response", None), (None, "response", None), (None, "response", None), (None, "revisit", 3)]


def test_warc_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = warc.op8(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.payload_bytes, r.payload_digest) == (len(pages[r.page_id].encode()), hashlib.sha256(pages[r.page_id].encode()).hexdigest())


def test_warc_revisits_nulls_and_broken_urls(spark, tmp_path):
    long, short = "é" * 60, "x" * 99
    rows = [(5, "u\r\nX: y", long), (2, None, long), (9, "u", long), (1, "u", short), (3, "u", short), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.0\r\n\r\nx" * 900)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, digest string")
    warc.archive(df, f"file://{tmp_path}/a")
    got = {r.page_id: r for r in warc.digests(spark, f"file://{tmp_path}/a").collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), **{i: ("response", None) for i in (1, 3, 4, 6, 7)}}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    warc.archive(df.limit(0), f"file://{tmp_path}/b")
    assert warc.digests(spark, f"file://{tmp_path}/b").count() == 0


def test_warc_shuffled_join_equals_broadcast(spark, tmp_path, monkeypatch):
    from longview.llm import common

    df = spark.createDataFrame([(i, "u", "y" * 200 + str(i % 3)) for i in range(40)], "page_id long, url string, html string")
    monkeypatch.setattr(common, "is_small", lambda *_: False)
    warc.archive(df, f"{tmp_path}/a")
    got = {r.page_id: r.refers_to for r in warc.digests(spark, f"{tmp_path}/a").collect()}
    assert got == {i: None if i < 3 else i % 3 for i in range(40)}


@pytest.mark.parametrize("pack", [bytes, gzip.compress, warc.gzip_member])
def test_warc_reads_other_archives(spark, tmp_path, pack):
    recs = [{"record_type": t, "record_id": f"<urn:x:{i}>", "payload": b"p\r\n\r\n" * i} for i, t in enumerate(["warcinfo", "response", "request", "response"])]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(pack(warc.record_bytes(r)) for r in recs))
    warc.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r.record_id, bytes(r.payload)) for r in df.collect()) == [(r["record_id"], r["payload"]) for r in recs]
    some = df.where("record_type = 'response' and record_id in ('<urn:x:3>', '<urn:x:0>')")
    assert [bytes(r.payload) for r in some.collect()] == [recs[3]["payload"]]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "response" not in plan  # no filter on the value is left above the scan
    assert spark.read.format("warc").option("payload", "false").load(str(tmp_path)).where("payload is not null").count() == 0
