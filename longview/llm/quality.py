"""Quality rules with thresholds that adapt to each language and source.

Every document gets a few whole-text measures. For each (lang, source) a mergeable quantile sketch
is kept of each measure: a log-linear histogram whose bins are exact integers, so that sketches are
merged by adding counts and do not depend on partitions or their order. A bin is at most 1/32 of its
value wide. Thresholds are fences read from the sketches: a document is rejected where a measure lies
beyond ``quartile +- FENCE * spread``; groups with fewer than ``MIN_GROUP`` documents use the merged
sketch of their language, and languages with fewer use that of the corpus: so few give no quartiles to go by. A group
of which more than a quarter has a defect takes it for usual; ``base_failed`` does not depend on fences.

Only DataFrame functions run here. The texts are read once, into a narrow table of measures; hot
sources are combined before the shuffle, and thresholds are joined by :func:`common.lookup`.

Defined cases: a null text counts as empty; a null language or source is a group of its own; repeated
rows are measured and judged alike; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import lookup, settle

SPACE = r"[\x20\x09-\x0D]+"
#: measure: (expression in thousandths, least spread, whether low values are rejected too)
MEASURES = {
    "mean_chars": ("1000 * word_chars div n_words", 1000, True),
    "symbols": ("1000 * n_symbols div n_words", 40, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 120, False),
    "repeats": ("1000 * n_repeat_words div n_words", 60, False),
}
FENCE = 3
MIN_GROUP = 100


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__words", F.array_remove(F.split(t, SPACE), ""))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    words = F.col("__words")
    df = df.withColumn("__n", F.size(words))
    # Windows are equal where their 64-bit hashes are; only texts with an equal pair are sorted.
    n_windows = F.greatest(F.col("__n") - 4, F.lit(0))
    hashes = F.when(F.col("__n") > 5, F.transform(F.slice(words, 1, n_windows), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, 5)])))
    df = df.withColumn("__hashes", hashes)
    may = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    df = df.withColumn("__sorted", F.when(may, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("w"), i.alias("i"))))))
    s = F.col("__sorted")
    twice = F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"])), lambda x: x.isNotNull())
    df = df.withColumn("__at", F.sort_array(twice))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    long = lambda c: c.cast("long")
    return df.select(
        *[F.col(c) for c in docs.columns],
        long(F.col("__n")).alias("n_words"),
        long(F.length(F.array_join(words, ""))).alias("word_chars"),
        long(F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).alias("n_symbols"),
        long(F.size("__lines")).alias("n_lines"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
    )


def bin_of(x: Column) -> Column:
    """The sketch's bin of an integer >= 0: itself below 64, else its six leading bits and their place."""
    e = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (e * 64 + F.call_function("shiftright", x, e)).cast("long")


def bin_top(b: Column) -> Column:
    """The largest integer in a bin."""
    e = F.floor(b / 64).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b % 64) + 1, e) - 1)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the sketches, combined on the map side."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.coalesce(F.expr(f"if(n_words > 0, {x}, 0)") if "n_lines" not in x else F.expr(f"if(n_lines > 0, {x}, 0)"), F.lit(0))).alias("bin")) for m, (x, _, _) in MEASURES.items()]))
    return measured.where("NOT base_failed").select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: its documents, and the lower and upper fence of each measure."""
    by = [*keys, "measure"]
    merged = sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    upto = merged.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("bin"))).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, bin_top(F.col("bin"))))
    quartiles = upto.groupBy(*by).agg(F.max("all").alias("docs"), q(25).alias("q1"), q(75).alias("q3"))
    least = F.coalesce(*[F.when(F.col("measure") == m, F.lit(s)) for m, (_, s, _) in MEASURES.items()])
    spread = F.greatest(F.col("q3") - F.col("q1"), least)
    out = quartiles.withColumn("lo", F.col("q1") - FENCE * spread).withColumn("hi", F.col("q3") + FENCE * spread)
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return out.groupBy(*keys).agg(F.max("docs").alias("docs"), *[pick(m, c).alias(f"{m}_{c}") for m in MEASURES for c in ("lo", "hi")])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source), with the fences of the narrowest group that has enough documents."""
    cols = [f"{m}_{c}" for m in MEASURES for c in ("lo", "hi")]
    tag = lambda df, t, drop=(): df.select(*[F.col(c).alias(c if c in drop else f"{t}_{c}") for c in df.columns])
    own, lang, every = fences(sketch, ["lang", "source"]), tag(fences(sketch, ["lang"]), "l"), tag(fences(sketch, []), "e")
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(every)  # every: one row
    use = lambda c: F.when(F.col("docs") >= MIN_GROUP, F.col(c)).when(F.col("l_docs") >= MIN_GROUP, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}")).alias(c)
    return both.select("lang", "source", *[use(c) for c in cols])


def _verdict() -> Column:
    """Whether a document's measures lie inside the fences joined to it."""
    ok = ~F.col("base_failed")
    for m, (x, _, low) in MEASURES.items():
        value = F.expr(f"if({'n_lines' if 'n_lines' in x else 'n_words'} > 0, {x}, 0)")
        ok = ok & (value <= F.col(f"{m}_hi"))
        if low:
            ok = ok & (value >= F.col(f"{m}_lo"))
    return F.coalesce(ok, F.lit(False))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, its measures, base_failed and kept."""
    measured = settle(_measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "measures")
    joined = lookup(measured, settle(thresholds(sketches(measured)), "thresholds"), ["lang", "source"], "doc_id")
    return joined.select(*measured.columns, _verdict().alias("kept"))


def _measured(docs: DataFrame) -> DataFrame:
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return text_measures(docs).withColumn("base_failed", base)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The texts are measured again for the verdict, so that they need not be shuffled to meet it.
    """
    measured = settle(_measured(docs.select("lang", "source", "text")).drop("text"), "measures")
    limits = settle(thresholds(sketches(measured)), "thresholds")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "lang", "source", "text")
    return lookup(_measured(rows), limits, ["lang", "source"], "doc_id").where(_verdict()).select("__row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")
