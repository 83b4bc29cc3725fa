"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into pieces that are encoded one by one; fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """text -> token ids, by the kind of the vocabulary file (.tiktoken, .json or .model); loaded once per worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path] = lambda text: t.encode(text, add_special_tokens=False).ids
        else:
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path).encode
    return _loaded[path]


def with_token_count(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns keep and n_tokens (INT): the size of the whole text; null text is null, empty text 0."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [None if t is None else len(encode(t)) for t in (x.as_py() for x in b["_text"])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(n, pa.int32())], [*keep, "n_tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
