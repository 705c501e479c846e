"""Line, substring and near dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_data import make_docs, words

from tidemark.llm import lines, simhash, substring


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def brute_lines(texts, ids):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(list)
    for doc, t in zip(ids, texts, strict=True):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(doc)
    out = {}
    for doc, t in zip(ids, texts, strict=True):
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != doc)]
        out[doc] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("options", [{}, {"exact_rows": 0}, {"filter_bytes": 0, "exact_rows": 0}])
def test_lines(docs, corpus, options):
    got = by_id(lines.dedup_lines(docs, ["h", "carried"], **options).collect())
    want = brute_lines(corpus, range(len(corpus)))
    assert {k: (r["n_lines"], r["n_dropped"], r["kept_text"]) for k, r in got.items()} == want
    assert sum(x[1] for x in want.values()) >= 7
    assert got[0]["carried"]["h"] == 1


def test_lines_null_ids_and_repeats(spark):
    line = "a line that is long enough to be counted as one"
    rows = [(None, line), (None, line), (1, line), (2, line), (2, line), (2, None)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_dropped"]) for r in got) == [(-1, 1), (-1, 1), (1, 1), (2, 0), (2, 0), (2, 0)]


def test_line_index_is_reversible(spark, corpus):
    old, new = make_docs(spark, corpus[:60]), make_docs(spark, corpus[60:], first=60)
    index = lines.LineIndex.build(old)
    before = {tuple(r) for r in index.counts.collect()}
    grown = index.insert(new)
    whole = lines.LineIndex.build(old.unionByName(new))
    assert {tuple(r) for r in grown.counts.collect()} == {tuple(r) for r in whole.counts.collect()}
    assert {tuple(r) for r in grown.delete(new).counts.collect()} == before


def filter_marks(index):
    """What the filters hold; a filter that deletions emptied holds as much as none."""
    found = {(r["shard"], r["buckets"]): lines.CuckooFilter.loaded(r["buckets"], r["filter"]).marks() for r in index.filters.collect()}
    return {k: marks for k, marks in found.items() if marks}


def test_line_index_keeps_its_filters(spark):
    text = lambda k: f"line number {k} that is long enough to be counted as one"
    schema = "doc_id long, text string"
    old = [(None, text(0))] * 2 + [(k, f"{text(0)}\n{text(k % 3)}") for k in range(9)]
    new = [(None, text(1)), (3, text(2)), (3, text(7))] + [(20 + k, f"{text(7)}\n{text(2)}") for k in range(4)]
    table = lambda rows: spark.createDataFrame(rows, schema)
    state = lambda index: ({tuple(r) for r in index.counts.collect()}, {tuple(r) for r in index.postings.collect()}, filter_marks(index))
    index = lines.LineIndex.build(table(old), min_docs=4)
    grown = index.insert(table(new))
    assert state(grown) == state(lines.LineIndex.build(table(old + new), min_docs=4))
    assert state(grown.merged()) == state(grown)
    assert state(grown.delete(table(new))) == state(index)  # id 3 and null keep the rows from before
    assert state(grown.delete(table(old)))[:2] == state(lines.LineIndex.build(table(new), min_docs=4))[:2]
    ids = table([(None, None), (3, None)]).select("doc_id")
    assert state(grown.delete_ids(ids))[:2] == state(lines.LineIndex.build(table([r for r in old + new if r[0] not in (None, 3)]), min_docs=4))[:2]
    with pytest.raises(ValueError, match="not in the index"):
        index.delete(table([(99, text(0))]))
    for options in ({}, {"exact_rows": 0}, {"filter_bytes": 0}):
        got = sorted((r["doc_id"] or -1, r["n_dropped"]) for r in grown.apply(table(old + new), **options).collect())
        assert got == sorted((r["doc_id"] or -1, r["n_dropped"]) for r in lines.dedup_lines(table(old + new), min_docs=4).collect())


def test_line_index_merges_its_tables(spark):
    line = "a line that is long enough to be counted as one"
    index = lines.LineIndex.build(spark.createDataFrame([(0, line)], "doc_id long, text string"))
    for k in range(1, lines.MOST_CHANGES + 1):
        index = index.insert(spark.createDataFrame([(k, line)], "doc_id long, text string"))
    assert len(index.tables) == 1 and index.counts.collect()[0]["n_docs"] == lines.MOST_CHANGES + 1


def test_full_filter_is_left_as_it_was():
    f = lines.CuckooFilter(1)
    rng = random.Random(2)
    keys = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(200)]
    for key in keys:
        before = f.table.copy()
        if not f.insert(*key):
            assert (f.table == before).all()
            break
    else:
        raise AssertionError("never full")


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 1 << 63, (2, 3000), dtype=np.int64).astype(np.uint64)
    f = lines.CuckooFilter.of(hi, lo)
    assert f.may_hold(hi, lo).all()
    assert f.may_hold(lo, hi).mean() < 0.01
    assert f.delete(int(hi[0]), int(lo[0]))
    assert f.may_hold(hi[1:], lo[1:]).all()


def brute_substrings(texts, n=35):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in split for k in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize(("bits", "hot"), [(28, 20_000), (6, 20_000), (28, 2)])
def test_substrings(docs, corpus, bits, hot):
    got = by_id(substring.dedup_substrings(docs, ["cid"], filter_bits=bits, hot=hot).collect())
    want = brute_substrings(corpus)
    assert [(got[k]["n_words"], got[k]["n_removed"], got[k]["kept_text"]) for k in range(len(corpus))] == want
    assert sum(x[1] for x in want) > 1000


def test_substrings_mutations(spark):
    rng = random.Random(3)
    base = words(rng, 400, 30)
    texts = []
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(3)] = words(rng, rng.randrange(3), 30)
        a = rng.randrange(300)
        texts.append(" ".join(own[a : a + rng.randrange(20, 300)]))
    got = by_id(substring.dedup_substrings(make_docs(spark, texts)).collect())
    assert [(got[k]["n_words"], got[k]["n_removed"], got[k]["kept_text"]) for k in range(len(texts))] == brute_substrings(texts)


def test_substrings_compare_words_not_hashes(spark):
    """Words that polynomial hashes modulo 2^64 cannot tell apart."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{k}" for k in range(34))
    got = by_id(substring.dedup_substrings(make_docs(spark, [f"{same} {one}", f"{same} {other}"])).collect())
    assert [got[k]["n_removed"] for k in (0, 1)] == [0, 0]


@pytest.mark.parametrize("collide", [False, True])
def test_factors_of_a_block(collide, monkeypatch):
    rng = random.Random(8)
    if collide:  # one seed for all places, so that words alone decide
        monkeypatch.setattr(substring, "_between", lambda prefix, start, end, base: np.zeros(len(start), np.uint64))
    rows = [[rng.randrange(3) for _ in range(rng.randrange(5, 15))] for _ in range(40)] + [[7] * 9, [5, 6, 7, 8, 9]]
    n = np.array([1] * 41 + [2])
    begin = np.cumsum([0, *map(len, rows)])[:-1]
    count = np.array([len(r) - 4 for r in rows])
    found = substring.factors(np.array(sum(rows, []), np.int32), begin, np.zeros(len(rows), np.int64), count, n, 5)
    seen = Counter()
    for r, times in zip(rows, n.tolist(), strict=True):
        for k in range(len(r) - 4):
            seen[tuple(r[k : k + 5])] += times
    got = sorted((row, at + k) for row, at, windows in found for k in range(windows))
    assert got == [(i, k) for i, r in enumerate(rows) for k in range(len(r) - 4) if seen[tuple(r[k : k + 5])] > 1]
    assert (41, 0) in got and any(windows > 1 for *_, windows in found)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    parent = {k: k for k in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in fps}


def test_simhash(docs, corpus):
    got = by_id(simhash.near_groups(docs).collect())
    fps = {k: brute_fingerprint(t) for k, t in enumerate(corpus)}
    assert {k: r["fp"] & (1 << 64) - 1 for k, r in got.items()} == fps
    assert {k: r["component_id"] for k, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("bucket_rows", [4096, 20, 2])
def test_simhash_links_dense_balls(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(60):
            own = centre
            for b in rng.sample(range(64), rng.randrange(6)):
                own ^= 1 << b
            fps.add(own)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket_rows=bucket_rows)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components({x - (1 << 64) if x >> 63 else x: x for x in fps})
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({x: got.get(x, x) for (x,) in signed}) == groups(want)


def test_simhash_null_ids(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (None, "other words here now"), (4, "a b c d")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["component_id"] for r in got) == {4: 3, None: 1}


def test_empty(no_docs):
    assert lines.dedup_lines(no_docs).collect() == []
    assert substring.dedup_substrings(no_docs).collect() == []
    assert simhash.near_groups(no_docs).collect() == []
