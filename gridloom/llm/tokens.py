"""Token counts of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Place of the vocabulary file; pass another one where the cluster keeps it elsewhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and n_tokens of each row's whole text; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            n = [len(t) for t in enc.encode_ordinary_batch([x or "" for x in b.column(1).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(count, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint")
