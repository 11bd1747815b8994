"""64-bit similarity fingerprints over weighted word tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidings.functions import text as tx

VOTES = 1 << 18


def token_bits(tokens: pa.Array) -> np.ndarray:
    """(tokens, 64) bits of the first eight bytes of each token's SHA-256."""
    digests = b"".join(hashlib.sha256(t).digest()[:8] for t in tokens.cast(pa.binary()).to_pylist())
    return np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)


def _votes(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(votes per row and bit, tokens per row) of a list column. Every distinct token of a batch is
    hashed once."""
    sizes = pc.fill_null(pc.list_value_length(bags), 0).to_numpy(zero_copy_only=False).astype("int64")
    votes = np.zeros((len(sizes), 64), dtype="int64")
    encoded = bags.flatten().dictionary_encode()
    if len(encoded):
        bits, codes = token_bits(encoded.dictionary), encoded.indices.to_numpy(zero_copy_only=False)
        filled = np.flatnonzero(sizes)
        starts = np.cumsum(sizes[filled]) - sizes[filled]
        first = 0
        while first < len(filled):  # as many rows at a time as hold about VOTES tokens
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + VOTES, side="right")) - 1)
            end = starts[last] if last < len(filled) else len(codes)
            votes[filled[first:last]] = np.add.reduceat(bits[codes[starts[first] : end]], starts[first:last] - starts[first], axis=0, dtype="int64")
            first = last
    return votes, sizes


def simhash(df: DataFrame, key: str, weighted: list[tuple[Column, int]], name: str = "simhash", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, fingerprint) of each row's weighted texts.

    A bit is set when the weight of the tokens whose hash has it outweighs the rest. Tokens are cut in
    the JVM; hashes and bit votes are counted in whole Arrow batches. Rows never move, so no shuffle is
    needed however long or skewed the texts are. A null text gives a null fingerprint, a text without
    tokens gives 0.
    """
    weights = [w for _, w in weighted]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.num_columns - len(weights)
            votes, total = np.zeros((batch.num_rows, 64), dtype="int64"), np.zeros(batch.num_rows, dtype="int64")
            missing = np.zeros(batch.num_rows, dtype=bool)
            for column, weight in zip(batch.columns[held:], weights):
                own, sizes = _votes(column)
                votes += weight * own
                total += weight * sizes
                missing |= column.is_null().to_numpy(zero_copy_only=False)
            prints = np.packbits(votes * 2 > total[:, None], axis=1).view(">i8").astype("int64").ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(prints, mask=missing)], [*batch.schema.names[:held], name])

    bags = [tx.tokens(column).alias(f"_bag{n}") for n, (column, _) in enumerate(weighted)]
    kept = df.select(key, *keep)
    return df.select(key, *keep, *bags).mapInArrow(fingerprints, T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())]))


def item_fingerprints(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint per item with the title counted 25 times, so page furniture shared by a site
    does not make its articles look alike. ``keep`` names further columns to carry along."""
    return simhash(items, "item_id", [(F.col("title"), 25), (F.col("text"), 1)], keep=keep)
