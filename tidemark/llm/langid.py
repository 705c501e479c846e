"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells texts of the languages with
that bit from the others. The classifiers are multinomial naive Bayes over hashed character n-grams (1 to 3,
lower-cased, runs of non-letters as one blank), fitted on counts over all labelled training rows; only
sums per (language, n-gram bucket) reach the driver. Decoding is loss-weighted: classifier j
counts for language i by how often it was right on texts of i, measured on a calibration
sample of about ``CALIBRATION_ROWS`` training rows a language. The nearest codeword wins; ``score`` is
1 - nearest / second nearest weighted loss, and ``ambiguous`` flags a score under ``AMBIGUOUS``.

Defined cases: text that is null or has no letter is ``und`` with score 0; without any labelled
row every text is; with one language every other text has it with score 1; ties go to the
language that sorts first; repeated rows and null ids are predicted like any other; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
CALIBRATION_ROWS = 1000
AMBIGUOUS = 0.1
UNKNOWN = "und"
SHARP = 8.0


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +-1: exhaustive up to seven languages, else the best of random dense codes by least distance."""
    if n <= 7:
        cols = range(1, 1 << (n - 1)) if n > 1 else []
        return np.array([[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for c in cols] for i in range(n)], np.int8).reshape(n, -1)
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        if (np.abs(code.sum(axis=0)) < n).all() and apart.min() > most:
            best, most = code, apart.min()
    return best


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text; None without a letter."""
    if not any(map(str.isalpha, text)):
        return None
    low = text.lower()
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (cp - 97) < 26
    keep = ascii_letter | (cp >= 0xAA)
    cp = np.where(keep, cp, 32)
    both = np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])
    cp = np.concatenate([np.array([32], np.uint32), cp[both], np.array([32], np.uint32)])
    a, b = cp * np.uint32(0x9E3779B1), cp * np.uint32(0x85EBCA77)
    two = a[:-1] ^ (b[1:] + np.uint32(0x7F4A7C15))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ b[2:]
    mask = np.uint32(buckets - 1)
    return sum(np.bincount(((h ^ (h >> np.uint32(15))) & mask).astype(np.int32), minlength=buckets) for h in (a, two, three))


class Codes:
    """The fitted model: languages, codewords, log-odds and weights of classifiers."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages, self.code = languages, codewords(len(languages))
        n, bits = self.code.shape
        self.odds = np.zeros((counts.shape[1], bits), np.float32)
        for j in range(bits):
            sides = [counts[self.code[:, j] == s].sum(axis=0) + 0.5 for s in (1, -1)]
            p, q = (np.log(s / s.sum()) for s in sides)
            self.odds[:, j] = p - q
        self.weights = np.full((n, bits), 1 / max(1, bits))

    def margins(self, hist: np.ndarray) -> np.ndarray:
        """Mean log-odds of each bit, scaled."""
        at = np.flatnonzero(hist)
        return SHARP * (hist[at] @ self.odds[at]) / max(1, hist.sum())

    def weigh(self, right: np.ndarray, seen: np.ndarray) -> None:
        rate = np.maximum((right + 1) / (seen[:, None] + 2) - 0.5, 1e-3)
        self.weights = rate / rate.sum(axis=1, keepdims=True)

    def decode(self, margins: np.ndarray) -> tuple[int, float]:
        if len(self.languages) == 1:
            return 0, 1.0
        loss = (self.weights * np.logaddexp(0, -self.code * margins[None, :])).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        return int(order[0]), float(1 - loss[order[0]] / loss[order[1]])


def fit(train: DataFrame, buckets: int = BUCKETS, calibration_rows: int = CALIBRATION_ROWS) -> Codes | None:
    """Learns from text and lang of ``train`` (lang not null). None without such rows."""
    rows = train.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in common.slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (hist := grams(text, buckets)) is not None:
                    if lang not in sums:
                        sums[lang], docs[lang] = np.zeros(buckets + 1, np.int64), 0
                    sums[lang][:-1] += hist
                    sums[lang][-1] += 1
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not summed.num_rows:
        return None
    lang_of, bucket, n = summed.column(0).to_pylist(), summed.column(1).to_numpy(), summed.column(2).to_numpy()
    languages = sorted(set(lang_of), key=lambda x: x.encode())
    place = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(languages), buckets + 1))
    counts[[place[x] for x in lang_of], bucket] = n
    model = Codes(languages, counts[:, :-1])
    if len(languages) > 1:
        _calibrate(rows, model, dict(zip(languages, counts[:, -1], strict=True)), calibration_rows)
    return model


def _calibrate(rows: DataFrame, model: Codes, docs: dict[str, float], most: int) -> None:
    spark = common.session(rows)
    given = spark.sparkContext.broadcast(model)
    # a share of the range of text hashes for each language; never nothing, however many documents a language has
    share = F.create_map(*[F.lit(x) for lang, n in docs.items() for x in (lang, max(1, int(min(1.0, most / n) * (1 << 62))))])
    part = rows.where(F.shiftrightunsigned(F.xxhash64("text"), 2) < share[F.col("lang")].cast("long"))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        place = {x: k for k, x in enumerate(own.languages)}
        hits, seen = np.zeros(own.code.shape, np.int64), np.zeros(len(own.languages), np.int64)
        for batch in common.slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (hist := grams(text, own.odds.shape[0])) is not None:
                    hits[place[lang]] += (own.margins(hist) * own.code[place[lang]] > 0).astype(np.int64)
                    seen[place[lang]] += 1
        i, j = np.indices(hits.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(hits.ravel()), pa.array(np.repeat(seen, hits.shape[1]))], ["i", "j", "right", "seen"])

    sums = part.mapInArrow(right, "i long, j long, right long, seen long").groupBy("i", "j").agg(F.sum("right"), F.sum("seen")).collect()
    hits, seen = np.zeros(model.code.shape), np.zeros(len(model.languages))
    for i, j, r, s in sums:
        hits[i, j], seen[i] = r, s
    model.weigh(hits, seen)


def predict(docs: DataFrame, model: Codes | None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carried, lang_pred, score, ambiguous) for each row, from its text alone."""
    given = common.session(docs).sparkContext.broadcast(model)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), common.carried(docs, carry).alias("carried"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        for batch in common.slices(batches):
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                hist = grams(text, own.odds.shape[0]) if own is not None and text is not None else None
                best, score = own.decode(own.margins(hist)) if hist is not None else (None, 0.0)
                langs.append(UNKNOWN if best is None else own.languages[best])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([s < AMBIGUOUS for s in scores])], ["doc_id", "carried", "lang_pred", "score", "ambiguous"])

    return base.mapInArrow(work, f"doc_id long, carried {base.schema['carried'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
