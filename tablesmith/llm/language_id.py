"""Language ID by compression: a text belongs to the language whose raw-content dictionary shrinks it most."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import id_crc, table

#: Bounds of the sample that the dictionaries are made of: documents a language, characters of a document's window, bytes a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 256, 512, 96 * 1024
#: Search that finds repeats of three bytes: common endings and short words tell languages apart.
SEARCH = {"strategy": "STRATEGY_LAZY2", "min_match": 3, "search_log": 4}
#: What a dictionary saves levels off at some KB however long the text is, so a margin is taken of so many bytes at most.
MARGIN_BYTES = 64 * 1024
UNKNOWN = "und"


def fit(labelled: DataFrame, per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, size: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, raw dictionary) for each language of labelled (doc_id, text, lang), the most frequent language first.

    Rows without a language or a letter teach nothing. Of each language, the per_lang documents with the smallest
    hashes of id and text give a window of up to `chars` characters each, at a place that the hash decides; so null
    and repeated ids are rows like any other, equal rows count once, and the driver gets no more than per_lang
    windows a language. A dictionary is filled up to the eight bytes that the library asks for.
    """
    at = F.xxhash64(F.lit(5), "doc_id", "text")
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", at.alias("at"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("at").alias("kinds")).collect()
    if not counts:
        return []
    # a few times as many as are wanted; which of them are taken doesn't depend on the estimate
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 8 * per_lang / max(1, r["kinds"]))))])
    some = rows.filter(F.shiftrightunsigned("at", 34) < share[F.col("lang")] * (1 << 30))
    place = F.pmod("at", F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    some = some.select("lang", "at", F.substring("text", place.cast("int"), F.lit(chars)).alias("window")).groupBy("lang", "at").agg(F.min("window").alias("window"))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("at", 1), "at")
    picked = some.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_lang).collect()
    raw = {r["lang"]: "\n".join(p["window"] for p in sorted(picked, key=lambda p: p["nth"]) if p["lang"] == r["lang"]).lower().encode()[:size] for r in counts}
    return [(r["lang"], raw[r["lang"]].ljust(8, b"\n")) for r in sorted(counts, key=lambda r: (-r["n"], r["lang"]))]


def identify(docs: DataFrame, model: list[tuple[str, bytes]], min_margin: float = 0.0, into: str = "language") -> DataFrame:
    """docs with a struct column `into` (in place of one of that name): lang, score, rejected.

    score is the share by which the best dictionary beats the second best; with one language, by which it beats
    no dictionary at all (0 if it does not help). Null texts and
    texts without a letter are `und`, score 0, and rejected. If no language was learned, every text is `und`, but
    those with letters are not rejected, as nothing speaks against them. Others are
    rejected where the bytes saved over the second best are less than min_margin of its size, or of MARGIN_BYTES if
    that is less, so no text is too long; they keep their best guess. Equal sizes go to the more frequent
    language. Whole texts are compressed, however long, after lower-casing. Other columns pass through.
    """
    spoken = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model:
        return docs.withColumn(into, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), (~spoken).alias("rejected")))
    langs = [lang for lang, _ in model]
    dictionaries = [raw for _, raw in model]

    @F.arrow_udf("struct<best int, score double, margin double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard as zstd

        search = SEARCH | {"strategy": getattr(zstd, SEARCH["strategy"])}
        how = zstd.ZstdCompressionParameters.from_level(3, write_content_size=False, write_dict_id=False, **search)
        coders = []
        for raw in dictionaries:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=how).compress)
        plain = zstd.ZstdCompressor(compression_params=how).compress if len(coders) == 1 else None
        for texts in batches:
            best, scores, margins = [], [], []
            for text in texts:
                raw = (text.as_py() or "").lower().encode()
                sizes = [len(c(raw)) for c in coders]
                k = min(range(len(sizes)), key=sizes.__getitem__)
                second = max(sizes[k], len(plain(raw))) if plain else min(s for i, s in enumerate(sizes) if i != k)
                best.append(k)
                scores.append((second - sizes[k]) / second)
                margins.append((second - sizes[k]) / min(second, MARGIN_BYTES))
            yield pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], ["best", "score", "margin"])

    out = docs.withColumn(into, judge(F.when(spoken, F.col("text"))))
    name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.col(f"{into}.best") + 1)
    return out.withColumn(
        into,
        F.struct(
            F.when(spoken, name).otherwise(UNKNOWN).alias("lang"),
            F.when(spoken, F.col(f"{into}.score")).otherwise(0.0).alias("score"),
            (~spoken | (F.col(f"{into}.margin") < min_margin)).alias("rejected"),
        ),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1
    model = fit(docs.filter(~held_out))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


QUERIES = {"op5_language_id": op5_language_id}
ORACLES = {}
