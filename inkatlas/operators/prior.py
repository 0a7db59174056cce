"""Character frequencies and the smoothed prior over languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkatlas.functions.text import char_of, is_space
from inkatlas.operators.parallel import spread


def character_counts(documents: DataFrame, language: str, text: str) -> DataFrame:
    """``(language, code_point, n)``: occurrences of each character that is no white space, per language.

    Characters are counted on the bytes of whole batches of texts, so a task gives one row for each language and
    character of a batch, not one for each character of its texts. White space is dropped after counting, on distinct
    characters. Rows with a null language are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            for number, name in enumerate(coded.dictionary):
                # One language's texts lie behind one another in one buffer.
                texts = batch.column(1).filter(pa.array(which == number)).drop_null().cast(pa.large_string())
                data, ends = texts.buffers()[2], texts.buffers()[1]
                if data is None or not len(texts):
                    continue
                ends = np.frombuffer(ends, np.int64)
                octets = np.frombuffer(data, np.uint8)[ends[texts.offset] : ends[texts.offset + len(texts)]]
                counts = {c: int(n) for c, n in enumerate(np.bincount(octets[octets < 128], minlength=128)) if n}
                beyond = np.frombuffer(octets[octets > 127].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
                if len(beyond):
                    n = np.bincount(beyond)
                    found = np.flatnonzero(n)
                    counts |= dict(zip(found.tolist(), n[found].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(counts), pa.string()), pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["language", "code_point", "n"])

    texts = spread(documents.select(F.col(language).alias("language"), F.col(text).alias("text")).where("language IS NOT NULL AND text IS NOT NULL"))
    counted = texts.mapInArrow(run, "language string, code_point int, n bigint").groupBy("language", "code_point").agg(F.sum("n").alias("n"))
    return counted.where(~is_space(char_of(F.col("code_point"))))


def log_prior(counts: DataFrame, charset: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """``(code_point, total, log_prior)`` for each character of ``charset``: ln of the mean over languages of
    (n + s) / (T + s * N), T being the language's occurrences of charset characters and N the charset's size.

    Languages without any charset character do not take part; without a language the result is empty.
    """
    chars = charset.select("code_point").distinct()
    inside = counts.join(chars, "code_point", "left_semi").groupBy("language", "code_point").agg(F.sum("n").alias("n"))
    totals = inside.groupBy("language").agg(F.sum("n").alias("t"))
    size = chars.agg(F.count(F.lit(1)).alias("size"))  # one row
    scaled = totals.join(F.broadcast(size)).withColumn("base", F.lit(smoothing) / (F.col("t") + F.lit(smoothing) * F.col("size")))
    # What every character gets from every language is one number; only seen characters add to it.
    floor = scaled.agg(F.sum("base").alias("floor"), F.count(F.lit(1)).alias("languages"))  # one row
    seen = inside.join(scaled.select("language", "t", "size"), "language").groupBy("code_point").agg(F.sum(F.col("n") / (F.col("t") + F.lit(smoothing) * F.col("size"))).alias("more"), F.sum("n").alias("total"))
    return (
        chars.join(seen, "code_point", "left").join(F.broadcast(floor)).where("languages > 0")
        .select("code_point", F.coalesce("total", F.lit(0)).alias("total"), F.log((F.col("floor") + F.coalesce("more", F.lit(0.0))) / F.col("languages")).alias("log_prior"))
    )


def raise_to_floor(prior: DataFrame, flat: DataFrame, regular: int = 100) -> DataFrame:
    """Raise (never lower) the prior of ``flat`` characters to the median prior of the other characters that occur at
    least ``regular`` times, or to the smallest prior if there is none such."""
    marked = prior.join(flat.select("code_point").distinct().withColumn("flat", F.lit(True)), "code_point", "left").withColumn("flat", F.coalesce("flat", F.lit(False)))
    level = marked.agg(F.coalesce(F.percentile(F.when(~F.col("flat") & (F.col("total") >= regular), F.col("log_prior")), F.lit(0.5)), F.min("log_prior")).alias("level"))  # one row
    return marked.join(F.broadcast(level)).select("code_point", "total", "flat", F.when(F.col("flat"), F.greatest("log_prior", "level")).otherwise(F.col("log_prior")).alias("log_prior"))


def strided_sample(df: DataFrame, order: list, most: int = 60) -> DataFrame:
    """Every max(1, n // most)-th row in the given order, at most ``most``: a report's sample of a sorted list."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    numbered = df.withColumn("_rn", F.row_number().over(Window.orderBy(*order)) - 1).join(F.broadcast(total))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return numbered.where((F.col("_rn") % step == 0) & (F.col("_rn") / step < most)).drop("_rn", "_n")
