"""Hard negatives by exact integer scores from residue-number-system matrix products.

1. Rows: each component x becomes floor(scale * x); repeated rows are made one by a
   hash aggregate, so a row that a third of the table repeats is reduced before the
   shuffle. Rows are dealt into slots of a bounded number of vectors by their hash.
2. Scores: every anchor (a stated query set) goes to every slot. A task holds one
   slot's vectors as a matrix and streams the anchors past it in blocks: matrices are
   taken modulo small primes and multiplied in float32, where sums below 2^24 are
   exact; Chinese remaindering by mixed radix gives the signed scores. The primes are
   chosen for each block from the norms in it, so any finite component is exact.
3. Windowed selection, twice: the best rows of the anchor's label in each slot, then over
   all slots by a window on (score, vec_id); and, with each positive's score known, the best
   rows of other labels inside its score window, again by slot and then over all.

The slots grow with the query set (a quarter of it, up to ``slot_floats``), so that
anchors repeated for all slots stay within a few times the rows as long as memory allows.

Rows with a null vec_id or label, a null vector or a component that is null or not
finite take no part. Rows equal in vec_id, label and vector count once; a row with the
anchor's vec_id is never its partner; other rows that share a vec_id are rows of their
own. Vectors of different lengths have no score with each other; empty ones score 0.
Ties go to the smaller vec_id. A returned score outside a long raises OverflowError.
Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.operators.materialize import freeze

_EXACT = 1 << 24  # whole numbers up to here are exact in float32
_INNER = 512  # components multiplied before residues are taken again
_NONE = -(1 << 62)


def small_primes(inner: int, bound: int) -> list[int]:
    """The largest primes p with inner * (p // 2)^2 within float32's whole numbers, as many as cover -bound..bound."""
    p, out, product = 2 * math.isqrt(_EXACT // max(1, inner)) + 1, [], 1
    p = min(p, 4093)
    while product <= 2 * bound + 1:
        while p > 2 and any(p % k == 0 for k in range(2, math.isqrt(p) + 1)):
            p -= 1
        if p < 3:
            raise OverflowError("too few primes for these scores")
        if inner * (p // 2) ** 2 <= _EXACT:
            out.append(p)
            product *= p
        p -= 1
    return out


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p between -p // 2 and p // 2 (fmod is exact for any finite double)."""
    r = np.fmod(x, p)
    r -= p * np.rint(r / p)
    return r.astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-valued float64 matrices: int64, or Python integers where these don't hold them."""
    inner = min(_INNER, max(1, a.shape[1]))
    norm = [float(np.sqrt(np.square(x).sum(1).max(initial=0.0))) for x in (a, b)]
    if not all(map(math.isfinite, norm)):
        norm = [float(np.abs(x).max(initial=0.0)) * math.sqrt(inner * -(-a.shape[1] // inner)) for x in (a, b)]
    bound = math.ceil(norm[0]) * math.ceil(norm[1]) * (1 << 20) // ((1 << 20) - 1) + 2
    primes = small_primes(inner, bound)
    whole = math.prod(primes)
    digits: list[np.ndarray] = []
    for p in primes:
        ra, rb, r = _residues(a, p), _residues(b, p), None
        for k in range(0, max(1, a.shape[1]), inner):
            part = (ra[:, k:k + inner] @ rb[:, k:k + inner].T).astype(np.int32) % p
            r = part if r is None else r + part
        for q, d in zip(primes, digits):  # mixed radix: what the earlier primes say goes out
            r = (r - d) % p * pow(q, -1, p) % p
        digits.append(r % p)
    kind = np.int64 if whole < 1 << 62 else object
    score, weight = np.zeros(digits[0].shape, kind), 1
    for p, d in zip(primes, digits):
        score = score + d.astype(kind) * weight
        weight *= p
    return np.where(score > whole // 2, score - whole, score)


class _Slot:
    """The vectors of one slot, by length of vector, in the order of their ids."""

    def __init__(self):
        self.parts: dict[int, list] = {}
        self.ready: dict[int, tuple] | None = None

    def add(self, ids, labels, vectors) -> None:
        for width, at, m in vectors:
            self.parts.setdefault(width, []).append((ids[at], labels[at], m))

    def blocks(self, width: int, rows: int):
        if self.ready is None:
            self.ready = {}
            for w, parts in self.parts.items():
                ids, labels, m = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(ids, kind="stable")
                self.ready[w] = ids[order], labels[order], m[order]
            self.parts = {}
        if width in self.ready:
            ids, labels, m = self.ready[width]
            for i in range(0, len(ids), rows):
                yield ids[i:i + rows], labels[i:i + rows], m[i:i + rows].astype(np.float64)


def _matrices(column: pa.Array, scale: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a list column by their length: length, rows, matrix of floor(scale * x)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat, start, size = column.values.to_numpy(zero_copy_only=False), ends[:-1], np.diff(ends)
    out = []
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        q = np.floor(flat[start[at][:, None] + np.arange(w)].astype(np.float64) * scale)
        out.append((w, at, q.astype(np.float32) if np.abs(q).max(initial=0.0) <= _EXACT else q))
    return out


def _best(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, count: int):
    """Row, id and score of the ``count`` best allowed columns of each row; ids are in order, so that the first of equals is the smallest."""
    left = np.where(allowed, score, _NONE if score.dtype != object else -math.inf)
    rows = np.arange(len(left))
    for _ in range(min(count, left.shape[1])):
        k = left.argmax(1)
        top = left[rows, k]
        some = np.flatnonzero(top > (_NONE if score.dtype != object else -math.inf))
        if not len(some):
            return
        yield some, ids[k[some]], top[some]
        left[rows, k] = _NONE if score.dtype != object else -math.inf


def _merged(found: list[tuple], count: int) -> list[tuple]:
    """Of (who, id, score) chunks: the ``count`` best of each who."""
    who, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, who)) if score.dtype != object else np.array(
        sorted(range(len(who)), key=lambda i: (who[i], -score[i], ids[i])), np.int64)
    who, ids, score = who[order], ids[order], score[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    keep = rank < count
    return [(who[keep], ids[keep], score[keep])]


def _stream(scale: float, find, schema: pa.Schema, anchors_at_once: int = 128, rows_at_once: int = 8192):
    """Rows sorted by (slot, kind): vectors (kind 0) fill the slot, anchors (kind 1) are held against it by ``find``."""
    def run(batches):
        slot, held = None, _Slot()
        for b in batches:
            slots, kinds = b.column("slot").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (slots[1:] != slots[:-1]) | (kinds[1:] != kinds[:-1])]).tolist()
            for i, k in zip(cuts, [*cuts[1:], b.num_rows]):
                if slots[i] != slot:
                    slot, held = slots[i], _Slot()
                part = b.slice(i, k - i)
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                vectors = _matrices(part.column("embedding"), scale)
                if kinds[i] == 0:
                    held.add(ids, labels, vectors)
                    continue
                for width, at, m in vectors:
                    for x in range(0, len(at), anchors_at_once):
                        some = at[x:x + anchors_at_once]
                        a = m[x:x + anchors_at_once].astype(np.float64)
                        found: list = []
                        for r_ids, r_labels, r in held.blocks(width, rows_at_once):
                            same = labels[some][:, None] == r_labels
                            other = ids[some][:, None] != r_ids
                            found = find(part, some, exact_scores(a, r), same, other, r_ids, found)
                        for who, got, score in found:
                            who, nth = np.divmod(who, 1 << 20)
                            t = part.take(pa.array(some[who]))
                            rows = {"key": t.column("key"), "anchor_id": t.column("vec_id"), "nth": pa.array(nth, pa.int32()),
                                    "other_id": pa.array(got, pa.int64()), "score": pa.array(score.tolist(), pa.int64())}
                            yield pa.RecordBatch.from_arrays([rows[c] for c in schema.names], schema=schema)
    return run


_FOUND = pa.schema([("key", pa.int64()), ("anchor_id", pa.int64()), ("nth", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "key long, anchor_id long, nth int, other_id long, score long"


def _positives(count: int):
    def find(part, some, score, same, other, ids, found):
        new = [(who << 20, got, top) for who, got, top in _best(score, same & other, ids, count)]
        return _merged(found + new, count) if found or new else []
    return find


def _negatives(count: int, low_pct: int, high_pct: int):
    def find(part, some, score, same, other, ids, found):
        lists = part.column("scores").take(pa.array(some)).to_pylist()
        for nth in range(max(map(len, lists), default=0)):
            rows = np.array([i for i, x in enumerate(lists) if len(x) > nth])
            best = [int(lists[i][nth]) for i in rows]
            lo, hi = (np.array(x, object) for x in ([-(-low_pct * s // 100) for s in best], [high_pct * s // 100 for s in best]))
            if score.dtype != object:  # bounds beyond all scores of the block are as good as its bounds
                lo, hi = (np.clip(x, _NONE, 1 << 62).astype(np.int64) for x in (lo, hi))
            s = score[rows]
            allowed = ~same[rows] & other[rows] & (s >= lo[:, None]) & (s <= hi[:, None])
            found = found + [(rows[who] << 20 | nth, got, top) for who, got, top in _best(s, allowed, ids, count)]
        return _merged(found, count) if found else []
    return find


def usable(vectors: DataFrame, every: int) -> DataFrame:
    """vec_id, label, embedding and key of the rows that take part, repeated rows once; labels of every ``every``-th id are moved."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    d = d.where("vec_id is not null and label is not null and embedding is not null")
    d = d.where(F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False))))  # NaN is above infinity
    if every:
        d = d.withColumn("label", F.expr(f"if(vec_id % {every} = 0, (label + 1) % 10, label)"))
    return d.dropDuplicates(["vec_id", "label", "embedding"]).withColumn("key", F.xxhash64("vec_id", "label", "embedding"))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95,
         scale: float = 256.0, relabel_every: int = 0, slot_rows: int = 8192, slot_floats: int = 1 << 24) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score (see the module)."""
    rows = freeze(usable(vectors, relabel_every))
    size = rows.agg(F.count("*"), F.count(F.when(anchors, 1)), F.max(F.size("embedding"))).first()
    most = max(slot_rows, min(size[1] // 4, slot_floats // max(1, size[2] or 1)))
    slots = max(1, -(-size[0] // most))
    asked = rows.where(anchors)
    dealt = rows.select(F.pmod("key", F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("kind"), "vec_id", "label", "embedding", "key",
                        F.array().cast("array<long>").alias("scores"))

    def held_against(queries: DataFrame, find) -> DataFrame:
        every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("kind"), "vec_id", "label",
                               "embedding", "key", "scores")
        return (dealt.unionByName(every).repartition(slots, "slot").sortWithinPartitions("slot", "kind", "key")
                .mapInArrow(_stream(scale, find, _FOUND), _FOUND_SQL))

    def best(found: DataFrame, count: int) -> DataFrame:
        w = Window.partitionBy("key", "nth").orderBy(F.desc("score"), "other_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)

    found = held_against(asked.withColumn("scores", F.array().cast("array<long>")), _positives(positives))
    firsts = freeze(best(found, positives).select("key", "anchor_id", F.col("rank").alias("nth"), F.col("other_id").alias("positive_id"),
                                                  F.col("score").alias("positive_score")))
    listed = firsts.groupBy("key").agg(F.expr("transform(array_sort(collect_list(struct(nth, positive_score))), x -> x.positive_score)").alias("scores"))
    found = held_against(asked.join(listed, "key"), _negatives(negatives, low_pct, high_pct))
    worst = best(found.withColumn("nth", F.col("nth") + 1), negatives)
    return (worst.join(firsts.drop("anchor_id"), ["key", "nth"])
            .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.expr("vec_id % 50 = 0"), relabel_every=7)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}

ORACLE = {"op13_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3"""}
