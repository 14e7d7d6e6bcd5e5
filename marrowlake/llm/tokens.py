"""Token counts of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies on the driver, which sends it to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_known: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY, raw: bytes | None = None):
    """The tokenizer of a vocabulary file, loaded once a process; raw is the file's content where it is at hand."""
    if vocabulary not in _known:
        import tiktoken

        if raw is None:
            with open(vocabulary, "rb") as f:
                raw = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _known[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _known[vocabulary]


def count_tokens(df: DataFrame, text: str, keep: list[str], out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep and `out`, the number of tokens of the whole text; 0 for null and empty texts.

    Text of special tokens counts as ordinary text. Only keep and text are read.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*(df.schema[c] for c in keep), StructField(out, LongType(), False)])

    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, None if vocabulary in _known else shared.value)
        for b in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)
