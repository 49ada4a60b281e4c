"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens: its documents in the order of (bucket of the
id, id), every document ended by the separator. In each round every queue earns
its target share of a window; what it can't spend yet (less than ``chunk``
tokens) is its deficit and is carried to the next round, across windows and
partitions alike. Served chunks, round by round and queue by queue, make one
stream, which is cut into windows of ``window`` tokens: only the last window is
padded. A queue that is empty earns nothing and the others share the windows.

The schedule is closed-form: chunk c of queue s is served in round
ceil((c + 1) * chunk / quantum) - 1, and its place in the stream is the sum of what
all queues have been served before. So a task needs only the queue table and the
place of its documents in their queues, which comes from sums by (queue, bucket)
and a running sum inside each bucket. Nothing is ordered globally, and a hot source
is spread over its buckets. Up to ``max_queues`` sources have a queue each. With
more, every source that ``targets`` names, the null source and the largest others
(half of ``max_queues``) keep a queue of their own; the small remaining ones share
a sixteenth of ``max_queues`` by hash.

Null text counts as empty (the separator alone); a null source is a queue of its
own; repeated rows are packed once each; rows with a null id are packed too;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from shelfwise.operators.materialize import freeze

_SCALE = 16  # a quantum is a fixed-point number of tokens with 16 binary places
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def _encoder(path: str) -> tiktoken.Encoding:
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def tokenize(docs: DataFrame, vocabulary: str, separator: int, kind: str) -> DataFrame:
    """The input's doc_id and source with n and ids (little-endian, of the given numpy kind, separator last)."""
    schema = "doc_id long, source string, n long, ids binary"

    def run(batches):
        for b in batches:
            enc = _encoder(vocabulary)
            ids = [np.array([*enc.encode_ordinary(t or ""), separator], kind) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "source", "n", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, schema)


def _schedule(totals: np.ndarray, shares: np.ndarray, window: int) -> np.ndarray:
    """Quantum of each queue: its share of a window, fixed-point, at least one unit."""
    return np.maximum(1, np.floor(shares / shares.sum() * window * (1 << _SCALE))).astype(np.int64)


def place(queue: np.ndarray, chunk_no: np.ndarray, totals: np.ndarray, quanta: np.ndarray, chunk: int) -> np.ndarray:
    """Place in the stream of the first token of each chunk.

    A queue is served to its end in its last round; later rounds count as that one, so
    products stay below the tokens of a queue times 2^17, which ``pack`` bounds.
    """
    unit = np.int64(chunk << _SCALE)
    rounds = -(-((chunk_no + 1) * unit) // quanta[queue]) - 1
    last = -(-(-(-totals // chunk) * unit) // quanta)
    out = np.empty(len(queue), np.int64)
    some = max(1, (1 << 20) // max(1, len(totals)))
    for i in range(0, len(queue), some):
        r, q, c = rounds[i:i + some, None], queue[i:i + some], chunk_no[i:i + some]
        before = np.minimum(totals, chunk * (np.minimum(r, last) * quanta // unit))
        after = np.minimum(totals, chunk * (np.minimum(r + 1, last) * quanta // unit))
        earlier = np.arange(len(totals)) < q[:, None]
        out[i:i + some] = before.sum(1) + ((after - before) * earlier).sum(1) + c * chunk - before[np.arange(len(q)), q]
    return out


def _pieces(queue, first, n, totals, quanta, window, chunk):
    """doc row, start in the document, length and place of the pieces of a batch of documents."""
    lo, hi = first // chunk, (first + n - 1) // chunk
    count = hi - lo + 1
    doc = np.repeat(np.arange(len(n)), count)
    c = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[doc]
    at = place(queue[doc], c, totals, quanta, chunk)
    begin, end = np.maximum(first[doc], c * chunk), np.minimum((first + n)[doc], (c + 1) * chunk)
    at, start, size = at + begin - c * chunk, begin - first[doc], end - begin
    # a chunk is at most a window long, so it is cut once at most
    head = np.minimum(size, window - at % window)
    cut = head < size
    doc, start, at, size = (np.concatenate(x) for x in ((doc, doc[cut]), (start, (start + head)[cut]), (at, (at + head)[cut]), (head, (size - head)[cut])))
    order = np.lexsort((start, doc))
    doc, start, at, size = doc[order], start[order], at[order], size[order]
    joined = np.r_[False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + size[:-1]) & (at[1:] // window == at[:-1] // window)]
    head = np.flatnonzero(~joined)
    return doc[head], start[head], np.add.reduceat(size, head), at[head]


def pack(docs: DataFrame, targets: dict[str, float] | None = None, window: int = 1024, separator: int = 0,
         vocabulary: str | None = None, chunk: int = 64, buckets: int = 4096, max_queues: int = 256) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids, doc_tokens, sequence_id, offset.

    ``targets`` gives the proportions of sources (a source that it doesn't name
    keeps its natural weight); without it every window has the corpus's proportions.
    """
    if window % chunk:
        raise ValueError("the chunk must divide the window")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = "<u2" if max(_encoder(vocabulary).max_token_value, separator) < 1 << 16 else "<u4"  # between stages only
    toks = freeze(tokenize(docs, vocabulary, separator, kind))
    # Queue names: '=' and a source, '#' and a hash, or 'null'. No null keys: the window's partitioning serves the join too.
    largest = toks.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(max_queues + 1).collect()
    name = F.concat(F.lit("="), F.col("source"))
    if len(largest) > max_queues:
        named = set(targets or {})
        others = [r["source"] for r in largest if r["source"] is not None and r["source"] not in named]
        own = sorted(named) + others[:max_queues // 2]
        shared = F.pmod(F.xxhash64("source"), F.lit(max(1, max_queues // 16))).cast("string")
        name = F.when(F.col("source").isNull() | F.col("source").isin(own), name).otherwise(F.concat(F.lit("#"), shared))
    name = F.coalesce(name, F.lit("null"))
    toks = toks.withColumn("queue", name).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.crc32("ids"))), F.lit(buckets)))
    sums = freeze(toks.groupBy("queue", "bucket").agg(F.sum("n").alias("n")))
    queues = sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()  # max_queues rows, the null source's and those of targets at most
    queues.sort(key=lambda r: r["queue"])
    totals = np.array([r["n"] for r in queues], np.int64)
    if len(totals) and totals.max() >= 1 << 45:
        raise OverflowError("a queue of 2^45 tokens and more")
    shares = totals / max(1, totals.sum())
    if targets:
        shares = np.array([targets.get(r["queue"][1:], s) if r["queue"][0] == "=" else s for r, s in zip(queues, shares)], float)
    quanta = _schedule(totals, shares, window) if len(totals) else totals
    number = {r["queue"]: i for i, r in enumerate(queues)}
    base = sums.select("queue", "bucket",
                       (F.sum("n").over(Window.partitionBy("queue").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("queue", "bucket").orderBy("doc_id", "n", F.crc32("ids")).rowsBetween(Window.unboundedPreceding, -1)
    placed = (toks.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(base, ["queue", "bucket"])
              .select("doc_id", "source", "queue", "n", "ids", (F.col("base") + F.col("before")).alias("first")))
    schema = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def cut(frames):
        for f in frames:
            if not len(f):
                continue
            q = np.array([number[x] for x in f["queue"]], np.int64)
            n = f["n"].to_numpy(np.int64)
            doc, start, size, at = _pieces(q, f["first"].to_numpy(np.int64), n, totals, quanta, window, chunk)
            raw = [np.frombuffer(x, kind) for x in f["ids"]]
            yield pd.DataFrame({
                "doc_id": f["doc_id"].astype("Int64").to_numpy()[doc], "source": f["source"].to_numpy()[doc], "start": start, "length": size,
                "ids": [raw[d][s:s + k].astype("<u4").tobytes() for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist())],
                "doc_tokens": n[doc], "sequence_id": at // window, "offset": at % window})
    return placed.mapInPandas(cut, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    got = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
