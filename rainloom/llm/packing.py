"""Filling fixed-capacity containers with items (problem 8): best-two-fit over documents sized in tokens.

Containers are filled greedily, longest item first.  Then a container's smallest item is replaced with two
unpacked items that fit the widened gap more tightly, if there are such.  Items are dealt by hash into blocks of
bounded size that are packed on their own; with thousands of items a block, a block's last containers are the
only ones that blocks cost.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2_048
#: Items that a block has on average.
BLOCK_ITEMS = 16_384
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item; sizes are whole numbers from 1 to ``capacity``."""
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError("sizes must be between 1 and the capacity")
    stock: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1]:
        stock.setdefault(int(sizes[i]), []).append(int(i))
    there = 0  # bit s is set while an item of size s is unpacked
    for s in stock:
        there |= 1 << s
    out = np.full(len(sizes), -1, np.int64)

    def largest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(s: int) -> int:
        nonlocal there
        i = stock[s].pop()
        if not stock[s]:
            there ^= 1 << s
        return i

    def give(s: int, i: int) -> None:
        nonlocal there
        stock[s].append(i)
        there |= 1 << s

    number = 0
    while there:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while (s := largest(gap)) > 0:
            inside.append((s, take(s)))
            gap -= s
        if gap and len(inside) > 1 and there:
            small, i = min(inside)
            wide = gap + small
            # two unpacked items, the larger one from the top down; a pair must fill more than the one did
            best, pair = small, None
            a = largest(wide - 1)
            while a > 0 and 2 * a > best:
                b = largest(min(a, wide - a))
                if b == a and len(stock[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == wide:
                        break
                a = largest(a - 1)
            if pair:
                inside.remove((small, i))
                give(small, i)
                inside += [(s, take(s)) for s in pair]
        for _, i in inside:
            out[i] = number
        number += 1
    return out


def token_counter(folder: str, vocabulary: str = VOCABULARY) -> bytes:
    """What a task needs to count tokens: the vocabulary file's bytes, well under 2 MB."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return f.read()


def token_sizes(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each document that has a text; special tokens' names are ordinary text."""
    shared = documents.sparkSession.sparkContext.broadcast(token_counter(folder, vocabulary))
    cache: dict = {}

    def run(batches):
        if "e" not in cache:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
            cache["e"] = tiktoken.Encoding("items", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = cache["e"].encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["d"].to_numpy(), "n_tokens": [len(encode(t)) for t in b["t"]]})

    x = documents.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return x.mapInPandas(run, "doc_id long, n_tokens long")


def packed(sizes: DataFrame, capacity: int = CAPACITY, n_blocks: int = 1) -> DataFrame:
    """Items (doc_id, n_tokens) in containers: (container_id, doc_id, piece, start_token, n_tokens).

    An item longer than the capacity is cut into full containers and a rest that is packed with the others; no
    other item is cut.  Items of NULL or no size, or without id, are in no container; rows with the same id are
    items of their own.  Every piece is in exactly one container.
    """
    x = sizes.where("doc_id is not null and n_tokens > 0").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(int(n_blocks))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "n_tokens"], kind="stable")
        size, ids = g["n_tokens"].to_numpy(np.int64), g["doc_id"].to_numpy()
        pieces = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(size[row] - start, capacity)
        number = pack(length, capacity)
        return pd.DataFrame({"container_id": (int(g["block"].iloc[0]) << 32) + number, "doc_id": ids[row], "piece": piece.astype("int32"), "start_token": start, "n_tokens": length})

    return x.groupBy("block").applyInPandas(run, "container_id long, doc_id long, piece int, start_token long, n_tokens long")


def document_containers(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Documents (doc_id, text) in containers of ``capacity`` tokens of the vocabulary in ``folder``; see :func:`packed`."""
    n_blocks = max(1, -(-documents.count() // block_items))
    return packed(token_sizes(documents, folder, vocabulary), capacity, n_blocks)
