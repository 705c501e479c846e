"""The training-data pipeline: five stages, each over all that its predecessor kept.

``run`` applies them to ``documents``; a driver may also call the stages one by one, with each result
written as Parquet and read again. All but the last return the columns of ``documents``. SQL cannot
express the language-ID stage, so there is no SQL for the whole; tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, langid, lines, packing, simhash

#: Ids of near copies are broadcast up to this many; beyond, they are joined.
SMALL_IDS = 500_000
#: Tasks that a group of near copies is dealt to.
SALTS = 64
#: Remembered chunks in a worker; fewer than by default, since workers go on to hold them while other stages run.
MEMO = 80_000


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "doc_id"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose two nearest codewords are about equally near."""
    model = langid.fit(docs)
    out = langid.predict(docs, model, _others(docs)).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return out.select("doc_id", "carried.*").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from the texts; n_chars follows. Every document stays."""
    out = lines.dedup_lines(docs, [c for c in _others(docs) if c != "text"])
    rest = [F.col(f"carried.{c}").alias(c) for c in _others(docs) if c not in ("text", "n_chars")]
    return out.select("doc_id", F.col("kept_text").alias("text"), F.char_length("kept_text").cast("long").alias("n_chars"), *rest).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest id (no id: after all others), then the smallest text hash.

    Rows are told apart by id and text, so another text with the same id is judged on its own; of equal rows of a group one stays."""
    th = F.xxhash64("text")
    rows = simhash.near_groups(docs.select("doc_id", "text", th.alias("th")), ["th"]).select("root", "doc_id", F.col("carried.th").alias("th"))
    keys = common.written(rows.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")), "near-keys")
    spot = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")
    # only groups of several rows need judging; each is dealt to many tasks, so that none takes a whole large group
    several = keys.groupBy("root").agg(F.min(spot).alias("least"), F.count(F.lit(1)).alias("c"), F.max("n").alias("most")).where("c > 1 OR most > 1")
    least = several.select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).withColumn("stays", F.col("least").eqNullSafe(spot))
    judged = common.written(judged.where("NOT stays OR n > 1").select(F.col("doc_id").alias("j_doc"), F.col("th").alias("j_th"), "stays"), "near-copies")
    given = F.broadcast(judged) if judged.count() <= SMALL_IDS else judged
    own = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)], docs["doc_id"].cast("long").alias("j_id"), th.alias("j_text"))
    both = own.join(given, own["j_id"].eqNullSafe(given["j_doc"]) & (own["j_text"] == given["j_th"]), "left")
    back = lambda df: df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
    kept = back(both.where("stays IS NULL"))
    if not judged.where("stays").head(1):
        return kept
    once = both.where("stays").groupBy("j_id", "j_text").agg(F.first(F.struct(*[f"c{k}" for k in range(len(docs.columns))])).alias("row"))
    return kept.unionByName(back(once.select("row.*")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    out = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _others(docs))
    return out.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select("doc_id", "carried.*").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece, with its ids."""
    return packing.pack(docs, _tokenizer(), memo=MEMO)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
