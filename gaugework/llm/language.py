"""Language by compression: the dictionary of a language that encodes a text shortest names it.

A raw-content dictionary holds sample text of one language. Every whole text is encoded, in pieces
of ``PIECE`` bytes, with each of them. The choice is narrow when the second best is nearly as short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.llm.arrow import arrow_schema, strings

SAMPLE_TEXTS = 64  # texts per language that fill its dictionary
SAMPLE_CHARS = 2_000  # of each of them, in one stretch from anywhere in the whole text
NARROW = 0.02  # a lead of the shortest encoding below this share is no decision
PIECE = 8192
UNKNOWN = "und"
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """What is encoded: lower case, a space for every ASCII character that is no letter."""
    return text.lower().encode("utf-8", "surrogatepass").translate(SPACED)


def dictionaries(docs: DataFrame, chosen: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, bytes]]:
    """(language, sample text), the commonest language first, from the chosen rows.

    A language gives at most ``SAMPLE_TEXTS`` x ``SAMPLE_CHARS`` characters; the rows are drawn by hash.
    """
    begin = F.pmod(F.xxhash64(text, F.lit(1)), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    piece = F.substring(F.col(text), begin.cast("int"), F.lit(SAMPLE_CHARS))
    rows = docs.filter(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0) & chosen).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("draw"), F.xxhash64(text).alias("hash"), piece.alias("text")
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
    drawn = Window.partitionBy("lang").orderBy("draw", "hash")
    first = rows.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= SAMPLE_TEXTS)
    found: dict = {}
    for row in first.join(sizes, "lang").orderBy(F.col("many").desc(), "lang", "nth").select("lang", "text").collect():
        found.setdefault(row["lang"], []).append(row["text"])
    return [(name, plain("\n".join(texts))) for name, texts in found.items()]


class Judge:
    def __init__(self, samples: list[tuple[str, bytes]]):
        self.names = [name for name, _ in samples]
        settings = zstandard.ZstdCompressionParameters.from_level(
            6, window_log=17, hash_log=16, chain_log=16, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.encoders = []
        for _, sample in samples:
            raw = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=settings)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and relative margin."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        data = plain(text)
        sizes = np.zeros(len(self.names))
        for a in range(0, len(data), PIECE):
            piece = data[a : a + PIECE]
            sizes += [len(e.compress(piece)) for e in self.encoders]
        best = int(sizes.argmin())
        second = np.delete(sizes, best).min(initial=np.inf)
        if not np.isfinite(second):
            return self.names[best], 1.0, 1.0
        gap = second - sizes[best]
        return self.names[best], float(1 / (1 + 2.0 ** -min(gap, 50))), float(gap / second)


def _teller(samples, schema: pa.Schema, narrow: float):
    def run(batches):
        judge = Judge(samples)
        for batch in batches:
            found = [judge(t) for t in strings(batch.column("text"))]
            names = [name for name, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([m for _, _, m in found], pa.float64()), pa.array([m < narrow for _, _, m in found], pa.bool_())],
                schema=schema,
            )

    return run


def languages(docs: DataFrame, samples: list[tuple[str, bytes]], doc_id: str = "doc_id", text: str = "text", narrow: float = NARROW) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, margin, rejected.

    ``margin`` is what the best encoding saves of the second best, ``score`` rises with the bytes
    saved from a half to 1. ``rejected`` marks a margin below ``narrow``: the best language is still
    named, but the text does not tell it from the second. A text that is null or has no letter is
    ``und`` with score 0 and rejected, and so is every text if there is no sample. Of equally short
    encodings the commonest language wins. Texts of any length are encoded whole. Repeated rows are
    judged alike; other columns are ignored; an empty table gives an empty result.
    """
    fields = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double, margin double, rejected boolean"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_teller(samples, arrow_schema(fields), narrow), fields)
