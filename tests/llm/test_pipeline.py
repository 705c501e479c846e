"""The pipeline's stages against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
from llm_data import make_docs, words
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_fingerprint, brute_lines
from test_models import brute_hits

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    line = "This licence line is repeated in very many of the documents."
    items = [(k, " ".join(words(rng, 40))) for k in range(3)]
    texts = [" ".join(words(rng, rng.randrange(30, 200))) for _ in range(40)]
    texts += [texts[0]] * 3 + [f"{t}\n{line}" for t in texts[1:9]] + [" ".join(words(rng, 30)) + " " + items[1][1]]
    texts += [None, "123 456", ""]
    docs = [(k, t, "en" if k % 3 else "fr", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {k: t for k, t, *_ in docs if t is not None and any(c.isalpha() for c in t)}
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = got.columns
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, got, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        got = spark.read.parquet(f"{tmp_path}/stage{k}")
        steps.append(got)
    rejected = set(kept) - {r["doc_id"] for r in steps[0].collect()}
    assert len(rejected) <= 1 and steps[0].columns == columns
    kept = {k: t for k, t in kept.items() if k not in rejected}

    want = brute_lines(list(kept.values()), list(kept))
    kept = {k: want[k][2] for k in kept}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in steps[1].collect()} == {k: (t, len(t)) for k, t in kept.items()}

    root = brute_components({k: brute_fingerprint(t) for k, t in kept.items()})
    kept = {k: t for k, t in kept.items() if root[k] == k}
    assert {r["doc_id"] for r in steps[2].collect()} == set(kept)
    kept = {k: t for k, t in kept.items() if not (lambda n, hit, _: hit and 20 * hit >= n)(*brute_hits(t, items))}
    assert {r["doc_id"] for r in steps[3].collect()} == set(kept)
    assert steps[3].columns == columns and steps[1].columns == columns

    rows = steps[4].collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    assert all(zlib.crc32(np.frombuffer(bytes(r["ids"]), "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"]) for r in whole if r["start"] == 0) == sorted((k, 0) for k in kept)


def test_stages_on_nothing_and_on_odd_rows(spark, no_docs, tmp_path):
    spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = make_docs(spark, [None, "", "a", "same text here", "same text here", "x " * 9000], lang=[None, "en", "en", None, "fr", "en"])
    odd = odd.unionByName(odd.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumn("n_hit", F.lit(1)).withColumn("component_id", F.lit(None).cast("long")).withColumn("kept_text", F.lit("k"))
    for docs in (no_docs, odd):
        got, columns = docs, docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, got, str(tmp_path))
            rows = out.collect()
            if name != "packing":
                assert out.columns == columns
                got = spark.createDataFrame(rows, docs.schema)
        assert bool(rows) == (docs is odd)


def test_near_dedup_judges_rows_not_ids(spark, tmp_path):
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 60, 5000)) for _ in range(3))
    rows = [(3, a)] * 3 + [(7, a), (7, b), (None, a), (None, a), (None, c), (None, c), (9, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(k, t, "j", n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, stays string, th int")
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == {(3, a): 1, (7, b): 1, (None, c): 1, (8, ""): 1}
