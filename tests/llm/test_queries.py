"""The registered queries over the smallest tables: against SQL where there is some, else their contract's columns and counts."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

COLUMNS = {
    "op3_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_brown_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_keeps_its_contract(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.toPandas()
    if name == "op9_ann":
        assert rows.groupby("query_id").size().eq(20).all()
        assert set(rows.query_id) == {r[0] for r in con.sql("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
    else:
        assert set(rows.doc_id) == {r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall()}
    if name == "op3_langid":
        truth = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
        held = rows[rows.held_out]
        assert (held.doc_id.map(truth) == held.lang_pred).mean() > 0.97
    if name == "op7_brown_lm":
        held = rows[rows.held_out]
        assert (rows.score < 0).all() and held.score.sum() > held.base_score.sum()


def test_registered_simhash_equals_brute_force(spark, con):
    from test_dedup import brute_components, brute_fingerprint

    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = {k: (f"{fps[k]:016x}", r) for k, r in brute_components(fps).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, DATA).collect()} == want


def test_registered_sharding_keeps_its_law(spark, con):
    rows = queries.op8_sharding(spark, DATA).toPandas()
    truth = dict(con.sql("SELECT doc_id, coalesce(strlen(text), 0) + 16 FROM documents").fetchall())
    assert dict(zip(rows.doc_id, rows["size"], strict=True)) == truth and set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    sizes = rows.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    # a cut misses its aim by no more than a text moved whole, and a leaf lies between the cuts of six levels
    assert (sizes - sizes.mean()).abs().max() <= 3 * max(truth.values())
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in rows.groupby("shard"))


def test_registered_packing_equals_the_tokenizer(spark, con):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    ids = {k: np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    rows = queries.op6_packing(spark, DATA).toPandas()
    for r in rows.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for k, x in rows.sort_values("start").groupby("doc_id"):
        assert x.start.tolist() == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() == len(ids[k])


def test_registered_neighbours_against_brute_force(spark, con):
    import numpy as np

    table = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    names, v = np.array([r[0] for r in table]), np.array([r[1] for r in table], np.float64)
    rows = queries.op9_ann(spark, DATA).toPandas()
    hits = 0
    for q, x in rows.sort_values("rank").groupby("query_id"):
        scores = v @ v[names == q][0]
        best = [k for _, k in sorted(zip(-scores, names, strict=True)) if k != q][:20]
        hits += len(set(best) & set(x.vec_id))
        assert np.allclose(x.score, [scores[names == k][0] for k in x.vec_id], rtol=1e-12) and x["rank"].tolist() == list(range(1, 21))
    assert hits >= 0.9 * len(rows)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 11)]
