"""The pipeline, stage by stage, on a real small table against brute force; and odd tables through the whole."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from spikeline.llm.common import materialize

from . import brute

D = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before, names = docs, [n for n, _ in pipeline.STAGES]
    rows = {}
    for name, stage in pipeline.STAGES:
        before = materialize(stage(spark, before, D), name)
        rows[name] = before.collect()
        if name != names[-1]:
            assert before.columns == docs.columns
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"]: r["text"] for r in rows["quality"]}
    assert good.items() <= whole.items() and 0 < len(good) < len(whole)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & good.keys()) <= 0.1 * len(bad & whole.keys())
    classes = brute.near(list(good.items()))
    first = {r["doc_id"]: r["text"] for r in rows["near_duplicates"]}
    assert first == {d: good[d] for d, (c, _, _) in classes.items() if c == d}
    removal = brute.window_removal(list(first.items()))
    cut = {r["doc_id"]: r["text"] for r in rows["repeated_passages"]}
    assert cut.keys() == {d for d, (n, gone, _) in removal.items() if n == 0 or gone < n}
    for d, text in cut.items():
        assert text == first[d] if removal[d][1] == 0 else brute.window_removal([(0, text)])[0][2] == removal[d][2]
    copies = Counter((r["doc_id"], r["text"]) for r in rows["mixture"])
    assert copies.keys() <= set(cut.items()) and max(copies.values()) <= 3
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {r["doc_id"]: r["source"] for r in rows["repeated_passages"]}
    for d, text in cut.items():
        sizes[source[d]] += len(brute.words(text))
        taken[source[d]] += copies[d, text] * len(brute.words(text))
    assert sum(taken.values()) > 0.9 * sum(sizes.values()) and all(taken[s] <= 3 * sizes[s] for s in sizes)
    pieces = Counter()
    for r in rows["packing"]:
        assert len(r["ids"]) == r["length"] <= 4096
        pieces[r["doc_id"]] += r["ids"].count(1)
    ends = Counter()
    for (d, _), n in copies.items():
        ends[d] += n
    assert all(pieces[d] >= n for d, n in ends.items()) and pieces.keys() == ends.keys()


def test_odd_tables_pass_all_stages(spark, tmp_path):
    words = " ".join(f"plain{i} words" for i in range(30))
    unlike = " ".join(f"other{i} things" for i in range(40))
    rows = [(None, None, None, None, None), (1, words, "en", "s", 5), (1, words, "en", "s", 5), (1, unlike, None, None, None), (2, "", "en", "s", 0), (3, words, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_found", "_row", "s_chars", "_n", "_kept", "key"):
        docs = docs.withColumn(name, F.lit("x"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= {None, 1, 2} and any(r["doc_id"] == 1 for r in packed)
    near = pipeline.near_duplicates(spark, docs, str(tmp_path))
    texts = Counter((r["doc_id"], r["text"]) for r in near.collect())
    assert texts == Counter([(None, None), (1, words), (1, rows[3][1]), (2, "")]) and near.columns == docs.columns
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
