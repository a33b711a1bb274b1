"""Problem 8: items of varying length packed into containers of fixed capacity.

The plan is made over the histogram of lengths, never over documents: at most ``capacity`` counts
reach the driver. Best fit, longest first: a pattern takes the longest length left and fills the
gap with the longest lengths that still fit; it is repeated as often as the counts allow, so every
pattern uses up a length and the plan has at most ``capacity`` patterns. Documents then take the
planned slots by their exact rank within their length.

Defined results: null texts and texts without a token need no room (container null, 0 tokens); a
text longer than the capacity, and no other, is cut into full pieces and one rest, which is packed
like any item; doc_ids that come twice count once; ties within a length are ordered by doc_id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.positions import all_positions
from quillmill.runtime import ship

ship(__name__)

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the tokenizer's vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every document; null texts have 0."""
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())  # the file's size is its bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, tokens bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(lengths in a container with their numbers, containers)] for a histogram of lengths up to the capacity."""
    left = {z: n for z, n in counts.items() if n > 0}
    sizes = np.array(sorted(left), np.int64)
    alive = np.ones(len(sizes), bool)
    out = []
    while left:
        used: dict[int, int] = {}
        room = capacity
        while room > 0:
            # the longest length that fits and isn't used up by this pattern
            i = int(np.searchsorted(sizes, room, "right")) - 1
            while i >= 0 and (not alive[i] or used.get(int(sizes[i]), 0) >= left[int(sizes[i])]):
                i -= 1
            if i < 0:
                break
            z = int(sizes[i])
            k = min(room // z, left[z] - used.get(z, 0)) if used else 1
            used[z] = used.get(z, 0) + k
            room -= z * k
        times = min(left[z] // k for z, k in used.items())
        out.append((used, times))
        for z, k in used.items():
            left[z] -= k * times
            if not left[z]:
                del left[z]
                alive[np.searchsorted(sizes, z)] = False
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first container, items of the length per container), sorted."""
    offset: dict[int, int] = {}
    base, rows = 0, []
    for used, times in patterns:
        for z, k in used.items():
            rows.append((z, offset.get(z, 0), base, k))
            offset[z] = offset.get(z, 0) + k * times
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _seater(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            z, pos = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            at = np.searchsorted(key, z << 48 | (pos - 1), "right") - 1
            seat = t[at, 2] + (pos - 1 - t[at, 1]) // t[at, 3]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(seat)], names=["doc_id", "piece_no", "tokens", "container"])

    return run


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, pattern: str = PATTERN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece_no, token_start, tokens, container) of every document."""
    spark = documents.sparkSession
    counts = token_counts(documents, id_col, text, tokenizer, pattern).groupBy("doc_id").agg(F.max("tokens").alias("n"))
    full = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")), lambda i: F.struct(i.alias("piece_no"), F.least(F.col("n") - i * capacity, F.lit(capacity)).cast("bigint").alias("tokens")))
    pieces = counts.select("doc_id", F.explode(full).alias("p")).select("doc_id", "p.piece_no", "p.tokens")
    placed, hist = all_positions(pieces, ["tokens"], [F.col("doc_id").asc(), F.col("piece_no").asc()])
    histogram = {r.tokens: r.n for r in hist.filter("tokens > 0").collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    seated = placed.filter("tokens > 0").select("doc_id", "piece_no", "tokens", "position").mapInArrow(_seater(table), "doc_id bigint, piece_no int, tokens bigint, container bigint")
    roomless = placed.filter("tokens = 0").select("doc_id", "piece_no", "tokens", F.lit(None).cast("bigint").alias("container"))
    return seated.unionByName(roomless).select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("token_start"), "tokens", "container")


def fill(packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused share, the fullest container's tokens."""
    per = packing.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (1 - F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("unused_share"))
