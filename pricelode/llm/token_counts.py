"""Token counts by the whole-token shortcut.

Offline (on the driver, once per tokenizer file) it is proved which vocabulary strings encode
alone as exactly one token. A pre-token that is such a string counts 1 without merging; only the
other distinct pre-tokens are merged, by the tokenizers library, once each. Counts are added up
per text. Texts with an added special string, or characters beyond the probed planes, are counted
by the library as a whole, so every count is the library's.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows, repeated or not, keep their
place; an empty table stays empty; other columns pass through, columns of the added names are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytescan import slices
from .common import map_batches
from .pretokens import prepared, pretokens


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than `limit` tokens) to every row; no shuffle."""
    parts = prepared(tokenizer_path)

    def count(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.string()), "")
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        encoder = pretokens(parts)
        counts = np.array([n for a, b in slices(sizes) for n in encoder.counts(texts[a:b].to_pylist())], np.int64)
        return [pa.array(np.diff(sizes)), pa.array(counts), pa.array(counts > limit)]

    return map_batches(docs, count, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()),
                                     ("over_limit", T.BooleanType())])
