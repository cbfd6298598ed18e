"""Registered queries of the corpus operators: thin digests over whole tables, with the production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import let, table, words
from flowscope.llm.twins import SQL  # noqa: F401  registered beside the queries
from flowscope.session import scratch_path

LANGUAGE_MARGIN = 0.005
SHARDS = 8
PII_KEY = "example key: deployments bring their own"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed file of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(modulus: int) -> Column:
    """Of the checksum of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.language import accepted, dictionaries, identify

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = dictionaries(docs.where(F.coalesce(remainder(4) != 2, F.lit(True))))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    found = identify(docs, model)
    return found.select("doc_id", held_out, "lang_pred", "score", accepted(LANGUAGE_MARGIN).alias("accepted"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.sharding import shard_rows

    return shard_rows(table(spark, folder, "documents"), SHARDS).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_kneser(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.kneser import learned, scored

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = learned(docs.where(F.coalesce(remainder(7) != 2, F.lit(True))))
    held_out = F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.decontaminate import overlaps

    found = overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("overlaps", lambda x: x["item_id"])))
    covered = F.aggregate("overlaps", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])
    return found.select(
        F.col("id").alias("doc_id"), (F.size("overlaps") > 0).alias("contaminated"), items.alias("item_ids"), covered.alias("overlap_tokens")
    )


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.bpe import Vocabulary, encode

    return encode(table(spark, folder, "documents"), Vocabulary(vocabulary_path()), ids=False)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.quality import quality

    trusted = table(spark, folder, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality(table(spark, folder, "documents"), trusted).withColumnRenamed("id", "doc_id")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.pii import pseudonymised

    fresh = pseudonymised(F.col("text"), PII_KEY)
    docs = table(spark, folder, "documents").select("doc_id", fresh.alias("text"), F.col("text").alias("before"))
    return docs.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))


def op8_neardup(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.neardup import linked

    found = linked(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.warc import archived

    records = archived(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.substring import repeated

    found = repeated(table(spark, folder, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", digest)


def op11_sequences(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.sequences import read_documents, write_sequences

    docs = table(spark, folder, "documents").select("doc_id", "text")
    files = scratch_path(spark, "sequences")
    manifest = write_sequences(docs, files, vocabulary_path("word_bpe_49k.json"))
    return read_documents(spark, manifest, files, docs.schema["doc_id"].dataType.simpleString())


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.negatives import hard_negatives

    rows = table(spark, folder, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sevenths = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.when(sevenths, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def planted_period(text: Column, h: Column) -> Column:
    """The text with one period repeated from some word on, as the digest's contract makes it."""
    g, n = F.floor(h / 10), lambda w: F.size(w).cast("bigint")

    def repeated(w: Column) -> Column:
        a = g % n(w)
        p = F.floor((n(w) - a) / (g % 8 + 3)) + 1
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    changed = let(words(text), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")))
    return F.when(h % 10 == 0, changed).otherwise(text)


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    from flowscope.llm.runs import periodic

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, folder, "documents").select("doc_id", planted_period(F.col("text"), h).alias("text"))
    found = periodic(docs)
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(longer(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_language": op1_language,
    "op2_sharding": op2_sharding,
    "op3_kneser": op3_kneser,
    "op4_decontamination": op4_decontamination,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_neardup": op8_neardup,
    "op9_warc": op9_warc,
    "op10_substring": op10_substring,
    "op11_sequences": op11_sequences,
    "op12_negatives": op12_negatives,
    "op13_periodic": op13_periodic,
}
