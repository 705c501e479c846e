"""Language ID, language model, decontamination, packing, sharding, neighbours and WARC against brute force."""

import cProfile
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_data import SCHEMA, make_docs, words
from pyspark.sql import functions as F

from tidemark.llm import ann, decontamination, langid, lm, packing, sharding, warc

TOKENIZERS = pytest.importorskip("public_tokenizers")


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def brute_hits(text, items, n=13):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    doc, hit, names = find(text), set(), set()
    for item, t in items:
        own = find(t)
        m = min(n, len(own))
        if item is None or not m:
            continue
        runs = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)}
        for k in range(len(doc) - m + 1):
            if tuple(doc[k : k + m]) in runs:
                hit.update(range(k, k + m))
                names.add(str(item))
    return len(doc), len(hit), sorted(names)


@pytest.mark.parametrize("index_bytes", [32 << 20, 2000])
def test_decontamination(spark, corpus, index_bytes):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, rng.randrange(14, 30)))) for k in range(12)]
    items += [(12, "Short item, HERE"), (13, None), (14, ""), (None, "the the"), (0, "second row of item zero is this one"), (15, "the " * 13), (16, items[3][1])]
    texts = [*corpus[:60], *[" ".join(words(rng, 20)) + " " + t + " end" for _, t in items if t], "short ITEM; here", "the " * 40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontamination.contamination(make_docs(spark, texts), bench, ["h"], index_bytes=index_bytes).collect())
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(t, items)
        assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"])
    none = decontamination.contamination(make_docs(spark, texts), bench.limit(0)).collect()
    assert {r["n_hit"] for r in none} == {0}


def test_language_id_held_out(spark):
    rng = random.Random(2)
    parts = {"en": ["th", "ing", "er", "an", "wh"], "fr": ["eau", "é", "qu", "ou", "en"], "de": ["sch", "ü", "ei", "ung", "ß"], "es": ["ñ", "ción", "ue", "rr", "as"], "xx": ["кот", "де", "жа", "ло"]}
    rows = [(lang, " ".join("".join(rng.choices(own, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80)))) for lang, own in parts.items() for _ in range(60)]
    rng.shuffle(rows)
    train, held = rows[:200], rows[200:]
    model = langid.fit(make_docs(spark, [t for _, t in train] + [None, "no label"], lang=[x for x, _ in train] + ["en", None]))
    got = by_id(langid.predict(make_docs(spark, [t for _, t in held] + [None, "", "12 %%", "a"]), model, ["carried"]).collect())
    assert sum(got[k]["lang_pred"] == x for k, (x, _) in enumerate(held)) >= 0.97 * len(held)
    assert [got[len(held) + k]["lang_pred"] for k in range(3)] == ["und"] * 3
    assert got[len(held) + 3]["lang_pred"] in parts
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_without_languages(spark, no_docs):
    docs = make_docs(spark, ["some text", None], lang=["en", "en"])
    assert langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert [r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()] == ["en", "und"]
    assert langid.predict(no_docs, None).collect() == []


@pytest.mark.parametrize("n", [2, 4, 7, 12, 30])
def test_codewords_correct_errors(n):
    code = langid.codewords(n).astype(int)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= (1 if n == 2 else 4 if n >= 4 else 2)


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


@pytest.mark.parametrize("head", [100_000, 60])
def test_language_model(spark, corpus, docs, head):
    train = docs.where("doc_id % 7 <> 2")
    model, counts = lm.learn(train, core=20, classed=50, classes=6, head=head)
    assert model.complete == (head == 100_000)
    got = by_id(lm.score(docs, model, counts).collect())
    seen = Counter(w for k, t in enumerate(corpus) if k % 7 != 2 for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    assert (model.tokens, model.types) == (n, v)
    of = {w: int(model.class_of[k]) for w, k in model.ids.items()}
    classes = int(model.class_of.max()) + 1
    classes = len(model.class_n) - 1 - lm.SHAPES
    at = lambda w: classes + lm.SHAPES if w == b"\n" else of.get(w, classes + lm.shape(w) if w != b"\n" else 0)
    step, total, types = Counter(), Counter(), defaultdict(set)
    for k, t in enumerate(corpus):
        if k % 7 != 2:
            own = [b"\n", *tokens(t)]
            for a, b in zip(own, own[1:], strict=False):
                step[at(a), at(b)] += 1
                total[at(b)] += 1
                types[at(b)].add(b)
    size = classes + lm.SHAPES + 1
    left = Counter()
    for (a, _), c in step.items():
        left[a] += c
    p1 = {c: (total[c] + 1) / (n + size) for c in range(size)}
    for k, t in enumerate(corpus):
        own, s = [b"\n", *tokens(t)], 0.0
        for a, b in zip(own, own[1:], strict=False):
            x, y = at(a), at(b)
            s += math.log10((step[x, y] + size * p1[y]) / (left[x] + size))
            if b != b"\n" and total[y]:
                s += math.log10(seen[b] / total[y] if y < classes else (seen[b] - lm.DISCOUNT if seen[b] else lm.DISCOUNT * len(types[y])) / total[y])
        r = got[k]
        assert (r["n_tokens"], r["n_known"]) == (len(own) - 1, sum(seen[w] > 0 for w in own[1:]))
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own[1:]), rel_tol=1e-9)
        assert math.isclose(r["score"], s, rel_tol=1e-9), k


@pytest.mark.parametrize("head", [100_000, 60])
def test_every_repeated_word_is_clustered(spark, corpus, docs, head):
    train = docs.where("doc_id % 7 <> 2")
    model, table = lm.learn(train, core=20, classes=6, head=head)
    texts = [tokens(t) for k, t in enumerate(corpus) if k % 7 != 2]
    seen = Counter(w for t in texts for w in t if w != b"\n")
    signed = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w, 42)).astype(np.int64))
    of = {r["h"]: (r["n"], r["class"]) for r in table.collect()}
    assert {signed(w): n for w, n in seen.items()} == {h: n for h, (n, _) in of.items()}
    classes = len(model.class_n) - 1 - lm.SHAPES
    assert all(0 <= c < classes if n >= lm.LEAST else c == -1 for n, c in of.values())
    assert any(n >= lm.LEAST for w, n in seen.items() if w not in model.head) == (head == 60)
    at = lambda w: classes + lm.SHAPES if w == b"\n" else c if (c := of.get(signed(w), (0, -1))[1]) >= 0 else classes + lm.shape(w)
    assert all(at(w) == model.class_of[k] for w, k in model.ids.items())
    for w, n in Counter(at(w) for t in texts for w in t).items():
        assert model.class_n[w] == n
    shapes = Counter(lm.shape(w) for w, n in seen.items() if n < lm.LEAST)
    got = by_id(lm.score(docs, model, table).collect())
    for k, t in enumerate(corpus):
        own, s = [b"\n", *tokens(t)], 0.0
        for a, b in zip(own, own[1:], strict=False):
            y = at(b)
            s += model.log_step[at(a), y]
            if b != b"\n" and model.class_n[y]:
                s += math.log10((seen[b] if y < classes else (1 - lm.DISCOUNT if seen[b] else lm.DISCOUNT * shapes[y - classes])) / model.class_n[y])
        assert math.isclose(got[k]["score"], s, rel_tol=1e-9), k


def test_sweeps_find_planted_classes_beyond_the_core(spark):
    rng = np.random.default_rng(5)
    noun = lambda: f"n{int(300 * rng.random() ** 2)}"
    verb = lambda: f"v{int(300 * rng.random() ** 2)}"
    made = make_docs(spark, [" ".join(x for _ in range(20) for x in (noun(), verb())) for _ in range(300)])
    model, table = lm.learn(made, core=8, classes=2, head=50)
    of = {r["h"]: r["class"] for r in table.collect() if r["n"] >= lm.LEAST}
    kinds = {k: Counter(of.get(int(np.uint64(xxhash.xxh64_intdigest(f"{k}{j}".encode(), 42)).astype(np.int64))) for j in range(300)) for k in "nv"}
    best = {k: max((c for c in v if c is not None), key=v.get) for k, v in kinds.items()}
    assert best["n"] != best["v"]
    assert all(v[best[k]] >= 0.97 * sum(n for c, n in v.items() if c is not None) for k, v in kinds.items())


def test_words_are_parsed_as_the_plain_way():
    rng = random.Random(6)
    made = lambda: "".join(rng.choice("aBZ .,\t\n\x0b\r\x1c\x85\xa0é1中-") for _ in range(rng.choice([0, 1, 5, 50]))) + "w" * rng.randrange(70)
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else made() for _ in range(rng.randrange(12))]
        at = rng.randrange(len(texts) + 1)
        lengths, h, shapes = lm._parsed(pa.array(texts, pa.string()).slice(at))
        words = [lm.tokens(t and t.encode()) for t in texts[at:]]
        flat = [w for own in words for w in own]
        assert lengths.tolist() == [len(own) for own in words]
        assert h.tolist() == [xxhash.xxh64_intdigest(w, 42) for w in flat]
        assert shapes.tolist() == lm._shapes(flat).tolist() == [lm.shape(w) for w in flat]


def test_contexts_are_counted_without_a_call_a_word(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["The", "a", "b,"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(200)]
    passes = []
    frame = type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: passes.append(f) or plain(self, f, *a, **k))
    table = lm._contexts(make_docs(spark, texts), {b"the": 0, b"a": 1}, 2, None, 2)
    calls = cProfile.Profile()
    calls.runcall(lambda: list(passes[0](iter([pa.record_batch([pa.array(texts)], ["text"])]))))
    assert sum(entry.callcount for entry in calls.getstats()) < 200 * 100 / 10

    size = 2 + lm.SHAPES + 1
    at = lambda w: size - 1 if w == b"\n" else {b"the": 0, b"a": 1}.get(w, 2 + lm.shape(w))
    cells, seen = defaultdict(Counter), Counter()
    for t in texts:
        own = [b"\n", *tokens(t)]
        seen.update(own[1:-1])
        for a, b in zip(own, own[1:], strict=False):
            cells[a][at(b)] += 1
            cells[b][size + at(a)] += 1
    got = {np.uint64(r["h"] % (1 << 64)): (r["n"], dict(np.frombuffer(r["cells"], lm.SUM).tolist())) for r in table.collect()}
    assert got == {xxhash.xxh64_intdigest(w, 42): (n, dict(cells[w]) if n >= 2 else {}) for w, n in seen.items()}


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(4)
    words_n, truth = 30, np.arange(30) % 3
    pairs = rng.poisson(np.where(truth[:, None] == (truth[None, :] + 1) % 3, 30, 1)).astype(float)
    of = lm.exchange(pairs, words_n, 3)
    assert len({(a, b) for a, b in zip(of.tolist(), truth.tolist(), strict=True)}) == 3


def test_language_model_without_training(spark, no_docs):
    model, counts = lm.learn(no_docs)
    got = lm.score(make_docs(spark, ["a b", None]), model, counts).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"]) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert lm.score(no_docs, model, counts).collect() == []


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_round_trip(spark, docs, corpus, window):
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = packing.pack(docs, path, window=window, keep_open=4).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, t in enumerate(corpus):
        whole = sorted(pieces[k], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in whole), "<u4").tolist()
        assert ids == [*own.encode(t or "", add_special_tokens=False).ids, 2]
        assert {r["doc_tokens"] for r in whole} == {len(ids)}
        assert [r["start"] for r in whole] == np.cumsum([0, *[r["length"] for r in whole]])[:-1].tolist()
    padding = 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *[r["length"] for r in rows]])[:-1].tolist()
        n = sum(r["length"] for r in rows)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    assert padding == 0


def test_chunk_tokenizer_equals_the_tokenizer(corpus):
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        own = packing.ChunkTokenizer(f.read(), memo=50)
    ref = Tokenizer.from_file(path)
    odd = ["It's we'll İstanbul ΣΑΣ été x\x01y a b \x1c q z 12³4 <b>&amp;</b> don'T \x7f ñÑ 中文字 😀😀", "'s'S 'LL", "ẞ ſ K Å ﬁ ①Ⅳ", "a <|endoftext|> b", "<| x"]
    for t in [*corpus, *odd]:
        assert np.frombuffer(own.encode(None if t is None else t.encode()), "<u4").tolist() == ref.encode(t or "", add_special_tokens=False).ids


def test_long_chunks_are_not_remembered():
    from tokenizers import Tokenizer

    path, rng = TOKENIZERS.path("word_bpe_49k.json"), random.Random(11)
    with open(path, encoding="utf-8") as f:
        own = packing.ChunkTokenizer(f.read())
    ref = Tokenizer.from_file(path)
    for alphabet in ("abcdefgh", "abc019+/=", "été中文字", "ab."):
        chunks = ["".join(rng.choices(alphabet, k=n)) for n in (packing.LONG // 4, packing.LONG, packing.LONG + 1, 3000)]
        for text in (" ".join(chunks), "".join(chunks) + "."):
            assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids
    assert 0 < max(map(len, [*own.young, *own.old])) <= packing.LONG


def test_sharding(spark, corpus, docs):
    got = sharding.kd_shards(docs, shards=7).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(corpus)))
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (corpus[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[corpus[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(7)) or max(sizes.values()) > sum(sizes.values()) / 7


def test_sharding_balance_with_a_hot_text(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng, rng.randrange(20, 60))) for _ in range(600)] + ["the same text " * 10] * 300
    rng.shuffle(texts)
    got = sharding.kd_shards(make_docs(spark, texts), shards=5).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 5
    assert max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean


def test_sharding_empty(spark, no_docs):
    assert sharding.kd_shards(no_docs).collect() == []
    got = sharding.kd_shards(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string"), shards=2).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 3


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 12, 0), (1040, [None] + [1.0] * 11, 0), (1060, [float("nan")] * 12, 0), (1080, [1.0] * 5, 0), (None, x[0].tolist(), 0), (0, x[0].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.neighbours(table, F.pmod("vec_id", F.lit(20)) == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    y = x.astype(np.float64)
    for q, found in got.items():
        score = (y * y[q]).sum(axis=1)
        order = [k for k in np.lexsort((np.arange(900), -score)) if k != q][:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(math.isclose(r["score"], score[r["vec_id"]], rel_tol=1e-12) for r in found)
        keys = [(-r["score"], r["vec_id"]) for r in found]
        assert keys == sorted(keys)
        hits += len({r["vec_id"] for r in found} & set(order))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.neighbours(table.where("vec_id > 990"), F.pmod("vec_id", F.lit(20)) == 0).collect() == []
    few = ann.neighbours(table.where("vec_id <= 5"), F.pmod("vec_id", F.lit(20)) == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4, 5]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/warc"


def test_warc_round_trip(spark, folder):
    rng = random.Random(9)
    html = ["<p>" + " ".join(words(rng, 40)) + "</p>" for _ in range(30)]
    rows = [(k, f"https://WWW{k % 4}.Example.com:443/a/{k}?q={k}#f", html[k % 30]) for k in range(100)]
    rows += [(200, None, html[0]), (201, "http://x.org/\r\nbad", None), (202, "http://x.org/s", "small"), (203, "http://x.org/s", "small"), (204, "no url", ""), (None, "http://x.org/n", html[1]), (None, "http://x.org/m", "é" * 60), (None, "http://x.org/m", "é" * 60), (5, "http://x.org/5", html[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in warc.round_trip(pages, folder).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    first = defaultdict(list)
    for k, _, h in rows:
        if k is not None:
            first[h].append(k)
    want = []
    for k, _, h in rows:
        n, low = len((h or "").encode()), min(first[h], default=None)
        revisit = n >= 100 and low is not None and k != low
        want.append((k, n, "revisit" if revisit else "response", low if revisit else None))
    key = lambda r: [str(x) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_look_up(spark, folder):
    rows = [(k, f"http://h{k % 7}.example.org/p{k % 50}", f"<html>{k}</html>" * 12) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    captures = warc.write_archives(pages, folder)
    index = warc.build_index(captures, folder, block_lines=8)
    assert index.shards == sorted(index.shards, key=lambda s: (s[1], s[2]))
    asked = spark.createDataFrame([("http://h3.example.org/p3", None), ("http://h0.example.org/p49", None), ("http://none.org/", None)], "url string, record_id string")
    got = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.look_up(asked, index).collect()}
    assert got == {(k, h) for k, u, h in rows if u in ("http://h3.example.org/p3", "http://h0.example.org/p49")}


def test_warc_empty(spark, folder):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), folder).collect() == []


def test_url_key():
    assert warc.url_key("https://A.b.example.com:443/x?y=1#z") == "com,example,b,a)/x?y=1"
    assert warc.url_key("http://u@h.org:8080") == "org,h:8080)/"
    assert warc.url_key(None) == ")"


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contamination(no_docs, bench).collect() == []
    assert packing.pack(no_docs, TOKENIZERS.path("word_bpe_49k.json")).collect() == []
    assert SCHEMA.startswith("doc_id")


@pytest.mark.parametrize("head", [1, 7, 40, 100, 700, 1000])
def test_most_frequent_cuts_ties_exactly(spark, head):
    rng = random.Random(3)
    rows = [(f"w{k}".encode(), 5 if k < 600 else rng.randrange(1, 90)) for k in range(700)]
    got = lm._most_frequent(spark.createDataFrame(rows, "word binary, n long"), head)
    assert got == sorted(rows, key=lm._rank)[:head]


def test_flat_vocabulary_is_classed(spark):
    texts = [" ".join(f"w{k:03}" for k in range(at, at + 10)) for at in range(0, 300, 5)]
    model, table = lm.clustered(make_docs(spark, texts), classes=4, head=100)
    assert len(model.head) == len(model.class_of) == 100
    assert table.where("class < 0").count() == table.where("n < 2").count()


def test_sharding_cuts_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(1, "x" * 140)] * 300 + [(k, "y" * rng.randrange(20, 200)) for k in range(2, 602)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 900 and max(size.values()) - min(size.values()) <= 2 * (200 + 16)
    for shard in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_calibration_rows_of_a_very_large_language(spark, monkeypatch):
    seen = []
    rows = spark.createDataFrame([(f"some words number {k}", "en") for k in range(50)] + [(f"autre texte {k}", "fr") for k in range(50)], "text string, lang string")
    monkeypatch.setattr(langid.Codes, "weigh", lambda self, right, n: seen.append(n))
    model = langid.fit(rows)
    langid._calibrate(rows, model, {"en": 50.0, "fr": 1e12}, 1000)
    assert seen[-1][0] == 50


def test_another_tokenizer_goes_through_the_library():
    import json

    from tokenizers import Tokenizer

    with open(TOKENIZERS.path("word_bpe_49k.json"), encoding="utf-8") as f:
        said = json.load(f)
    assert packing._splits_here(said)
    said["normalizer"]["normalizers"] = said["normalizer"]["normalizers"][:2]
    source = json.dumps(said)
    own = packing.ChunkTokenizer(source)
    assert not own.by_chunks
    text = "Mixed Case, 12 THINGS"
    assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == Tokenizer.from_str(source).encode(text, add_special_tokens=False).ids
