"""Token counts with a public tokenizer's vocabulary, given by its path."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(docs: DataFrame, columns: list[str], text: str, vocabulary: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """``columns`` of each document and its number of tokens, 0 for null and empty texts.

    The vocabulary (under 1 MB) is read once on the driver and sent along with the function, so executors need no
    copy of the file. Strings of special tokens are ordinary text.
    """
    ranks = Path(vocabulary).read_bytes()
    kept = docs.select(*columns, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + f", `{out}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], out])

    return kept.mapInArrow(run, schema)
