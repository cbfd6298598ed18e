"""Language identification by compression.

Each learned language has a raw-content dictionary: a bounded sample of labelled text (at most ``DICTIONARY_BYTES``
bytes, from the ``ROWS`` labelled texts with the least hash, equal parts of each). A text is cut into blocks of
``BLOCK_BYTES``; every block of the whole text is compressed with every dictionary, the sizes are added up, and the
language with the smallest sum is chosen. Texts are compared in lower case. Short blocks keep the dictionary useful in long texts, which would otherwise
teach the compressor their own words. Only the sample and the dictionaries made of it are bounded; they are the
model, of at most ``MAX_LANGUAGES * DICTIONARY_BYTES`` bytes, and it is sent to the workers.

The margin is 1 - best / second best. A text is rejected if its margin is below the given one, or if it is ``und``.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0; ties go to the language
that sorts first; rows with a null language or text teach nothing; with no learned language every text is ``und``;
with one, it is chosen with score 1; repeated rows get equal results; further columns are kept by the filter and
ignored by the scorer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.common import unused
from flowscope.llm.tokens import releasing

MAX_LANGUAGES = 64
DICTIONARY_BYTES = 64 * 1024
ROWS = 256
BLOCK_BYTES = 4096
#: Matches from three bytes on: words share short pieces within a language.
SEARCH = {"strategy": 3, "window_log": 18, "hash_log": 17, "chain_log": 16, "search_log": 3, "min_match": 3, "target_length": 16}
UNDETERMINED = "und"


def dictionaries(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, bytes]:
    """Dictionary of each language in the labelled rows. Raises if there are more than MAX_LANGUAGES."""
    part = DICTIONARY_BYTES // ROWS
    hashed = F.xxhash64(F.col(text))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), hashed.alias("hash"), F.col(text).alias("text")
    )
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    # the share of all hashes that leaves a few times ROWS texts of a language, so that little is exchanged
    share = F.lit(0.0)
    for size in sizes:
        share = F.when(F.col("lang") == size.lang, F.lit(min(1.0, 8 * ROWS / max(1, size.n)))).otherwise(share)
    rows = rows.where(F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53)) <= share)
    # a piece of the text from a place that its hash picks, so that common openings don't fill the dictionary
    start = F.pmod(F.col("hash"), F.greatest(F.length("text") - F.lit(part), F.lit(1)).cast("bigint")).cast("int") + 1
    pieces = rows.groupBy("lang", "hash").agg(F.min(F.lower(F.substr(F.col("text"), start, F.lit(part)))).alias("piece"))
    least = Window.partitionBy("lang").orderBy("hash")
    sample = pieces.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= ROWS)
    found: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r.rank)):  # at most MAX_LANGUAGES * ROWS pieces
        found.setdefault(row.lang, []).append(row.piece.encode())
    return {name: b" ".join(parts)[:DICTIONARY_BYTES] for name, parts in found.items()}


class Classifier:
    """Compressors of a worker, one for each language."""

    def __init__(self, model: dict[str, bytes]) -> None:
        import zstandard

        self.names = sorted(model)
        self.compressors = []
        bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        search = zstandard.ZstdCompressionParameters(**SEARCH, **bare)
        for name in self.names:
            content = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=search)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=search, dict_data=content))

    def __call__(self, text: str) -> tuple[str, float]:
        """Language and margin."""
        if not self.names:
            return UNDETERMINED, 0.0
        data = memoryview(text.lower().encode())
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.names[best], 1.0 if second is None else 1.0 - sizes[best] / second


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each document with lang_pred and score (the margin)."""
    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    narrow = docs.select(*keep, lettered.alias(unused(docs, "_lettered")))

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for batch in batches:
            texts = (x.as_py() for x in batch.column(len(keep)))
            answers = [(UNDETERMINED, 0.0) if x is None else classify(x) for x in texts]
            found, scores = pa.array([a for a, _ in answers], pa.string()), pa.array([b for _, b in answers], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found, scores], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)])
    return narrow.mapInArrow(releasing(classified), f"{fields}, lang_pred string, score double")


def accepted(margin: float) -> Column:
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= margin)


def keep_identified(docs: DataFrame, model: dict[str, bytes], margin: float, text: str = "text") -> DataFrame:
    """The documents, all columns, whose language is found with at least this margin."""
    verdict, width, place = unused(docs, "_lettered"), len(docs.columns), docs.columns.index(text)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for batch in batches:
            kept = []
            for has_letter, x in zip(batch.column(width).to_pylist(), batch.column(place), strict=True):
                name, score = classify(x.as_py()) if has_letter else (UNDETERMINED, 0.0)
                kept.append(name != UNDETERMINED and score >= margin)
            yield batch.filter(pa.array(kept, pa.bool_())).select(list(range(width)))

    flagged = docs.withColumn(verdict, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return flagged.mapInArrow(releasing(filtered), docs.schema)
