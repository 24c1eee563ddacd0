import public_tokenizers

import corpus_pipeline
from longview.llm import decontaminate, minhash, pieces, quality, suffixes

SF = "/root/testdata/sf0.001"


def test_stages_match_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(f"file://{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
        counts.append(kept[-1].count())
        if name != "encoding":
            assert kept[-1].columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept[1]) == ids(quality.judge(kept[0]).where("kept"))
    assert ids(kept[2]) == ids(minhash.near_duplicates(kept[1], 5).where("kept"))
    rest = {r.row.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffixes.remove(kept[2]).collect()}
    assert {r.doc_id: r.text for r in kept[3].collect()} == rest
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(kept[4]) == ids(decontaminate.matches(kept[3], items).where("size(item_ids) = 0"))
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    assert {r.doc_id: codec.decode(r.ids).decode() for r in kept[5].collect()} == texts
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] == counts[5] > 0
    assert sorted(corpus_pipeline.run(spark, SF).collect(), key=str) == sorted(kept[5].collect(), key=str)


def test_stages_with_nulls_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, ids string, row int, part int, kept int"
    rows = [(i, t, None, None, None, 1, "x", 2, 3, 4) for i, t in [(1, None), (2, ""), (None, "w " * 30), (3, "a b c d e f g h i j k l m n o p"), (3, "a b c d e f g h i j k l m n o p")]]
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
        got = stage(spark, df, SF)
        if name != "encoding":
            assert got.columns == df.columns
        assert got.count() == (2 if name == "quality_rules" else 5)


def test_encoding_is_decoded_and_checked(spark):
    import hashlib

    texts = {1: "Hello  world\n▁é", 2: "", 3: None, 4: "日本語 the\t"}
    got = corpus_pipeline.encoding(spark, spark.createDataFrame([*texts.items()], "doc_id long, text string"), SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in got)
