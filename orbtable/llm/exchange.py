"""Blocks of documents that ask the whole corpus about their keys.

A block holds some megabytes of documents. It sends each of its distinct 64-bit keys once, with a number,
to the shard that the key's top bits name; the shard combines the numbers of all blocks by sum or by
minimum (or by "others": the minimum, where two blocks or more asked) and answers each block in the order asked. Keys travel packed, many to a row, and a key is
combined inside a block first, so a frequent key is one entry per block: no shard gathers the rows
of a hot key, and the number of shards grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbtable.llm.common import power_of_two
from orbtable.session import scratch_path

#: Bytes of text of a block, at most (but for one longer document).
BLOCK_BYTES = 8 << 20
#: Bytes of text for which a shard is planned.
SHARD_BYTES = 2 << 20


#: Answer to a key that no other block has asked for, with how "others".
NOBODY = np.uint64(2**64 - 1)


def squeeze(a: np.ndarray | bytes) -> bytes:
    return zstandard.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), 1)


def swell(b: bytes, kind=None):
    raw = zstandard.decompress(b)
    return raw if kind is None else np.frombuffer(raw, kind)


def squeeze_ints(a: np.ndarray) -> bytes:
    """Non-negative integers by planes of bytes, which pack better than whole words."""
    wide = np.asarray(a, "<u8")
    return squeeze(wide.view(np.uint8).reshape(-1, 8).T)


def swell_ints(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(swell(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit hashes, by element; not symmetric."""
    z = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0xD1B54A32D192ED03) ^ b >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ z >> np.uint64(29)


def block_ids(start: int = 0) -> Iterator[int]:
    """Ids for the blocks of a task, told apart by the task's partition."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 24
    while True:
        yield at + start
        start += 1


def shards_for(total_bytes: int, least: int = 64) -> int:
    return power_of_two(max(least, total_bytes / SHARD_BYTES))


def ask(blocks: DataFrame, keys_of: Callable[[pd.Series], tuple[np.ndarray, np.ndarray]], how: str, shards: int, width: int = 6) -> DataFrame:
    """(block, answer, fresh): per block what the corpus says of its keys.

    `keys_of` gives for a row of `blocks` its distinct keys in rising order and their numbers (unsigned
    integers). `answer` holds the combined numbers in the same order, packed by squeeze_ints per shard;
    `fresh` counts the keys with a combined number above 0 of which this block is the first asker. Of a
    key, the shard's bits and the `width` bytes below them are compared.
    """
    bits = np.uint64(64 - (shards.bit_length() - 1))

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                keys, numbers = keys_of(row)
                cuts = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64)[:-1] << bits).tolist() + [len(keys)]
                rows = []
                for s in range(shards):
                    a, b = cuts[s], cuts[s + 1]
                    if a < b:
                        # the shard's own bits need not travel
                        rows.append((row["block"], s, (keys[a:b] << (np.uint64(64) - bits)).view(np.uint8).reshape(-1, 8)[:, 8 - width:].tobytes(), squeeze_ints(numbers[a:b])))
                yield pd.DataFrame(rows, columns=["block", "shard", "keys", "numbers"])

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        sizes = [len(k) // width for k in group["keys"]]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, 8 - width:] = np.frombuffer(b"".join(group["keys"]), np.uint8).reshape(-1, width)
        numbers = np.concatenate([swell_ints(b) for b in group["numbers"]])
        values, first, inverse = np.unique(keys.view("<u8").ravel(), return_index=True, return_inverse=True)
        if how == "sum":
            total = np.bincount(inverse, numbers.astype(np.float64), len(values)).astype(np.uint64)
        else:
            total = np.full(len(values), NOBODY, np.uint64)
            np.minimum.at(total, inverse, numbers)
            if how == "others":
                total[np.bincount(inverse, minlength=len(values)) < 2] = NOBODY
        new = np.zeros(len(keys), bool)
        new[first[total > 0]] = True
        ends = np.cumsum(sizes)
        out = total[inverse]
        return pd.DataFrame({"block": group["block"], "shard": group["shard"],
                             "answer": [squeeze_ints(out[b - n:b]) for n, b in zip(sizes, ends)],
                             "fresh": [int(new[b - n:b].sum()) for n, b in zip(sizes, ends)]})

    sent = blocks.mapInPandas(send, "block long, shard int, keys binary, numbers binary")
    heard = sent.groupBy("shard").applyInPandas(combine, "block long, shard int, answer binary, fresh long")
    return heard.groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "answer"))), lambda x: x["answer"]).alias("answer"), F.sum("fresh").alias("fresh"))


def beside(blocks: DataFrame, label: str) -> DataFrame:
    """`blocks` written in buckets of their id, so that later joins by block don't move them."""
    spark = blocks.sparkSession
    path = scratch_path(spark, label)
    name = "t_" + path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def answers(column) -> np.ndarray:
    """The numbers of an `answer` column's cell, in the order of the keys asked."""
    if column is None or not len(column):
        return np.zeros(0, np.uint64)
    return np.concatenate([swell_ints(b) for b in column])
