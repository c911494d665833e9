"""Token ids packed into rows of fixed length by best-fit decreasing.

Every Arrow batch of documents is tokenised, overlong documents are split into
pieces of at most ``length`` ids, and the pieces of a block are packed by
best-fit decreasing: longest first, each into the open row with the least space
that holds it. A segment tree over remaining capacities finds that row in
log(length) steps. A block holds at most ``block_tokens`` ids and one document,
so memory is bounded; nothing is shuffled, and a lost task is simply run again.
Rows of different blocks are not mixed: at most a few rows a block are part full.

A packed row holds the ids (padded), the cumulative segment lengths, the
positions, which restart at 0 with each segment, and for each segment its
document and its offset in that document's ids, so that every text can be put
together again byte for byte.

Defined results for odd input: null and empty texts are segments of length 0,
so every document is in some row; repeated rows are segments of their own; a
null id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import small_batches, tokenizer_file

LENGTH = 2048
PAD = 50256
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids of a block that are packed together.
BLOCK_TOKENS = 1_000_000


class Tokenizer:
    """Byte-level BPE without special tokens; decoding gives the bytes back."""

    def __init__(self, folder: str | None = None, name: str = VOCABULARY):
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(tokenizer_file(name, folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")


class CapacityTree:
    """Which capacities have an open row: a segment tree for the least one that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        if len(self.rows[capacity]) == 1:
            self._mark(capacity, 1)

    def _mark(self, capacity: int, step: int) -> None:
        k = capacity + self.size
        while k:
            self.counts[k] += step
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the open row with the least capacity >= ``least``."""
        k = least + self.size
        if not self.counts[k]:
            # Up until a right sibling has something, then down its left-most branch.
            while k > 1 and (k & 1 or not self.counts[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.counts[2 * k] else 2 * k + 1
        capacity = k - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self._mark(capacity, -1)
        return capacity, row


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers, each of at most ``length`` in all."""
    tree, rows = CapacityTree(length), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        capacity, row = found
        rows[row].append(k)
        tree.add(capacity - lengths[k], row)
    return rows


_SCHEMA = pa.schema(
    [
        ("pack_id", pa.string()), ("n_tokens", pa.int32()), ("token_ids", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())),
        ("position_ids", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ]
)
SCHEMA = "pack_id string, n_tokens int, token_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<bigint>, offsets array<bigint>, doc_tokens array<bigint>"


def _block(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int, name: str) -> pa.RecordBatch:
    pieces = [(d, ids, a) for d, ids in docs for a in range(0, max(len(ids), 1), length)]
    lengths = [min(length, len(ids) - a) for _, ids, a in pieces]
    out: dict[str, list] = {f: [] for f in _SCHEMA.names}
    for n, row in enumerate(best_fit(lengths, length)):
        own = [lengths[k] for k in row]
        cut = np.r_[0, np.cumsum(own)].astype(np.int32)
        total = int(cut[-1])
        ids = np.full(length, pad, dtype=np.int32)
        places = np.zeros(length, dtype=np.int32)
        for k, a, m in zip(row, cut, own, strict=False):
            start = pieces[k][2]
            ids[a : a + m] = pieces[k][1][start : start + m]
            places[a : a + m] = np.arange(m)
        out["pack_id"].append(f"{name}-{n}")
        out["n_tokens"].append(total)
        out["token_ids"].append(ids)
        out["cu_seqlens"].append(cut)
        out["position_ids"].append(places)
        out["doc_ids"].append([pieces[k][0] for k in row])
        out["offsets"].append([pieces[k][2] for k in row])
        out["doc_tokens"].append([len(pieces[k][1]) for k in row])
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in _SCHEMA], schema=_SCHEMA)


def pack(docs: DataFrame, length: int = LENGTH, pad: int = PAD, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows of ``SCHEMA``; ``folder`` names where the vocabulary lies on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, tokenizer, block, held, number = TaskContext.get(), Tokenizer(folder), [], 0, 0
        part = context.partitionId() if context else 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py() or "")
                block.append((doc_id.as_py(), ids))
                held += len(ids) + 1
                if held >= block_tokens:
                    yield _block(block, length, pad, f"{part}-{number}")
                    block, held, number = [], 0, number + 1
        if block:
            yield _block(block, length, pad, f"{part}-{number}")

    small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str, rows: int = 256) -> None:
    """Binary shards: little-endian uint32 id matrices of up to ``rows`` rows, with their segment cuts.

    Each Parquet row is a shard: ``ids`` (n_rows x length), ``cu_seqlens`` of all
    rows laid end to end (row cuts restart at 0), ``position_resets`` (where a
    segment begins in the flattened matrix), ``doc_ids``, ``offsets`` and the pack ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows).to_pylist()
                length = len(part[0]["token_ids"])
                ids = np.array([r["token_ids"] for r in part], dtype="<u4")
                resets = np.array([n * length + a for n, r in enumerate(part) for a in r["cu_seqlens"][:-1]], dtype="<u8")
                cuts = np.array([c for r in part for c in r["cu_seqlens"]], dtype="<u4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "n_rows": pa.array([len(part)], pa.int32()), "length": pa.array([length], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                        "cu_seqlens": pa.array([cuts.tobytes()], pa.binary()), "position_resets": pa.array([resets.tobytes()], pa.binary()),
                        "doc_ids": pa.array([[d for r in part for d in r["doc_ids"]]], pa.list_(pa.int64())),
                        "offsets": pa.array([[o for r in part for o in r["offsets"]]], pa.list_(pa.int64())),
                        "pack_ids": pa.array([[r["pack_id"] for r in part]], pa.list_(pa.string())),
                    }
                )

    schema = "n_rows int, length int, ids binary, cu_seqlens binary, position_resets binary, doc_ids array<bigint>, offsets array<bigint>, pack_ids array<string>"
    packed.mapInArrow(run, schema).write.parquet(path)


def unpack(packed: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, text): the documents again, for rows with distinct ids. Pieces meet by a shuffle on the id."""
    segments = packed.select("token_ids", "cu_seqlens", F.posexplode("doc_ids").alias("k", "doc_id"), "offsets")
    own = segments.select(
        "doc_id",
        F.struct(
            F.get("offsets", F.col("k")).alias("offset"),
            F.slice("token_ids", F.get("cu_seqlens", F.col("k")) + 1, F.get("cu_seqlens", F.col("k") + 1) - F.get("cu_seqlens", F.col("k"))).alias("ids"),
        ).alias("piece"),
    )
    whole = own.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))

    def run(ids: pa.Array) -> pa.Array:
        tokenizer = Tokenizer(folder)
        return pa.array([tokenizer.decode(x) for x in ids.to_pylist()], type=pa.string())

    return whole.select("doc_id", F.arrow_udf(run, "string")(F.col("ids")).alias("text"))
