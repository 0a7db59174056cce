"""Token counts of whole texts with a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary of a byte-level BPE as lines of "base64 rank"; override with the session setting inkatlas.tokenizer.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SETTING = "inkatlas.tokenizer"
#: Fixed value: the public word pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(df: DataFrame, path: str | None = None) -> str:
    return path or df.sparkSession.conf.get(SETTING, None) or DEFAULT_VOCABULARY


def load(path: str):
    """The tokenizer, loaded once for each worker process."""
    import base64

    import tiktoken

    kept = globals().setdefault("_LOADED", {})
    if path not in kept:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        kept[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def with_tokens(documents: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``(id, tokens, *keep)``: the number of tokens of each whole text, 0 for null and empty texts.

    Texts do not leave the task that reads them; only numbers go on.
    """
    path = vocabulary_path(documents, path)
    keep = keep or []
    chosen = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(["id bigint", "tokens bigint", *[f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:]]])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load(path)
        for pdf in batches:
            # A lone surrogate cannot be a token; it counts as the replacement character.
            texts = [t if isinstance(t, str) else "" for t in pdf["_text"]]
            pdf.insert(1, "tokens", [len(encoding.encode_ordinary(t)) for t in texts])
            yield pdf.drop(columns="_text")

    # Few input files would leave cores idle; otherwise texts stay where they are read.
    cores, parts = documents.sparkSession.sparkContext.defaultParallelism, chosen.rdd.getNumPartitions()
    return (chosen.repartition(cores) if parts < cores else chosen).mapInPandas(count, schema)
