"""Same and near-same records across splits, as an edit-distance join on segments.

Two records are near-same if at least ``similarity`` of the longer one's tokens also occur in the other in the same order.
Taking one record to the other then needs at most K tokens deleted and inserted, K from the evaluation record's length.
An evaluation record is cut at K+1 disjoint segments of one or two neighbouring tokens; K edits leave at least one whole,
so the training record holds it as a substring. More exactly (count edits from the left and take the first segment with
no more of them up to its end than segments before it): some segment i, counted from 0, is whole with exactly i edits on
its left. So its place differs by at most i, by an even or odd number as i is, and what follows it by the edits that are
left; other places are not matched.

Any K+1 disjoint segments will do, so the rarest are cut. What may be a segment is told by the tokens themselves: a rare
token alone, a frequent one with its right neighbour. A training record thus has one substring to match at each place.
Candidates are verified with banded dynamic programming. Equal records are one class throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import materialize, ship, small_side

SIMILARITY, MIN_TOKENS = 0.8, 8
#: Counters of the sketch that tells rare tokens, and marks of evaluation segments by which training substrings are left
#: out early; both are of fixed size, whatever the corpus, and neither changes the result.
SKETCH_BITS, MARK_BITS = 20, 24
#: A token is rare up to RARE counts, a segment hot from HOT; both at least so many times the average counter, as tokens share counters.
RARE, RARE_TIMES, HOT, HOT_TIMES = 64, 2, 4096, 32
#: Hot segments are matched by stretches of this many places, so one of them is many keys.
STRETCH = 16
#: Names of classes that a task remembers, so that it hands on copies once.
SEEN = 500_000
#: Classes in candidate pairs whose tokens are looked up by a broadcast list of their names; more are joined by shuffle.
LOOKUP_CLASSES = 1_000_000


def common_in_order(a: list[np.ndarray], b: list[np.ndarray], least: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs of ``a`` and ``b`` where they are ``least`` or more, else 0.

    Only the band that allows ``least`` is computed, for many pairs of like length at once. Inside a row of the band cells
    depend on each other only by their running maximum. Tokens are numbers from 0.
    """
    n, m, least = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64), np.asarray(least, np.int64)
    out = np.zeros(len(n), np.int32)
    order = np.flatnonzero(np.minimum(n, m) >= least)
    order = order[np.lexsort((m[order], n[order]))]
    i = 0
    while i < len(order):
        n0 = max(1, n[order[i]])
        k = i + 1
        while k < len(order) and n[order[k]] <= 1.2 * n0 + 2 and (k - i) * n0 < 400_000:
            k += 1
        own, i = order[i:k], k
        out[own] = _band([a[x] for x in own], [b[x] for x in own], n[own], m[own], int((n[own] - least[own]).max()), int((m[own] - least[own]).max()))
    return np.where(out >= least, out, 0)


def _band(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray, up: int, down: int) -> np.ndarray:
    """Cells (i, j) with -up <= j - i <= down of all pairs, ordered by ``n``; what is beyond an end is like no token."""
    rows, width, longest = len(a), up + down + 1, int(n[-1])
    x, y = np.full((longest, rows), -1, np.int32), np.full((rows, up + longest + width), -2, np.int32)
    for r, (p, q) in enumerate(zip(a, b)):
        x[: len(p), r] = p
        q = q[: longest + width]
        y[r, up : up + len(q)] = q
    prev, got = np.zeros((rows, width + 1), np.int32), np.zeros(rows, np.int32)  # prev[d] is the best of a[:i], b[:i - up + d]
    done = 0
    for i in range(1, longest + 1):
        # Cell d ends with the token b[i - up + d - 1], which stands at i + d - 1 behind the margin.
        best = np.maximum(prev[:, 1:], prev[:, :-1] + (y[:, i - 1 : i - 1 + width] == x[i - 1][:, None]))
        np.maximum.accumulate(best, 1, out=prev[:, :-1])
        prev[:, -1] = 0  # outside of the band
        while done < rows and n[done] == i:
            got[done] = prev[done, m[done] - i + up]
            done += 1
    return got


def _least(n: int, similarity: float) -> int:
    """Tokens of a record of n that must have a partner."""
    return int(np.ceil(similarity * n - 1e-9))


@lru_cache(maxsize=100_000)
def most_edits(n: int, similarity: float) -> int:
    """K: deletions and insertions from a record of ``n`` tokens to the farthest near-same one."""
    longest = min(int(n / similarity + 1e-9), n + int(2 / (2 * similarity - 1)) + 2)  # beyond, each token more allows fewer edits
    return max(n + m - 2 * _least(m, similarity) for m in range(n, max(n, longest) + 1))


def _sketch(rows: DataFrame) -> np.ndarray:
    """Counts of hashed tokens: at most 2 ** SKETCH_BITS rows come to the driver, pre-aggregated on the executors."""
    slot = F.pmod(F.xxhash64("token"), F.lit(1 << SKETCH_BITS)).cast("int")
    counts = rows.select(F.explode("words").alias("token")).groupBy(slot.alias("slot")).count().toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[counts["slot"].to_numpy()] = counts["count"].to_numpy()
    return out


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    b = np.atleast_1d(np.asarray(b, np.int64)).view(np.uint64)  # arrays wrap around, numbers would warn
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


class Cutter:
    """What may be a segment at each place of records, from their tokens' hashes and the sketch alone."""

    def __init__(self, counts: np.ndarray, similarity: float, min_tokens: int) -> None:
        mean = float(counts.mean())
        self.counts, self.similarity = counts, similarity
        self.rare, self.hot = max(RARE, RARE_TIMES * mean), max(HOT, HOT_TIMES * mean)
        if similarity <= 0.5 or any(most_edits(n, similarity) >= n for n in range(min_tokens, 400)):
            raise ValueError(f"records of {min_tokens} tokens have too few segments for a similarity of {similarity}")
        if similarity < 0.76 or any(most_edits(n, similarity) >= n // 2 for n in range(min_tokens, 400)):
            self.rare = np.inf  # too few pairs of tokens: each token is a segment

    def places(self, h: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, size, cost) of the segment that begins at each of the tokens; ``last`` are the records' last ones. Size 0: none."""
        c = self.counts[h & (len(self.counts) - 1)]
        after, c_after = np.roll(h, -1), np.roll(c, -1)
        alone = c <= self.rare
        size = np.where(alone, 1, np.where(last, 0, 2))
        return np.where(alone, _mixed(h, 0), _mixed(h, after)), size, np.where(alone, c, np.minimum(c, c_after))

    def cut(self, size: list[int], cost: list[int]) -> list[int]:
        """Where the K+1 segments begin, of the least bound on their cost that has so many disjoint ones."""
        n, wanted = len(size), most_edits(len(size), self.similarity) + 1

        def under(bound: int) -> list[int]:
            out, i = [], 0
            while i < n:
                if size[i] and cost[i] <= bound:
                    out.append(i)
                    i += size[i]
                else:
                    i += 1
            return out

        bounds = sorted(set(cost))
        low, high = 0, len(bounds) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if len(under(bounds[mid])) >= wanted else (mid + 1, high)
        found = under(bounds[low])
        return sorted(sorted(found, key=lambda i: (cost[i], i))[:wanted])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, the records' lengths and where they begin."""
    lists = batch.column("hashes")
    h = np.asarray(lists.flatten(), np.int64)
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return h, n, np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)


def _signature(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128 bits of each record, of which each token turns one; two records differ in no more bits than in tokens."""
    slot = _mixed(h, 1).view(np.uint64) >> np.uint64(57)
    bit = np.uint64(1) << (slot & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(slot >> np.uint64(6) == k, bit, np.uint64(0)), at).view(np.int64) for k in (0, 1)]


def _evaluation_segments(rows: DataFrame, cutter) -> DataFrame:
    """(key, cls, n, sa, sb, pos, no): the K+1 segments of each evaluation record; a hot one once for each stretch it may stand in."""

    def cut(batches):
        c = cutter.value
        for batch in batches:
            h, n, at = _flat(batch)
            if not len(h):
                continue
            last = np.zeros(len(h), bool)
            last[at + n - 1] = True
            key, size, cost = c.places(h, last)
            sizes, costs, out = size.tolist(), cost.tolist(), []
            for r, (i, k) in enumerate(zip(at.tolist(), n.tolist())):
                fewer, more = k - _least(k, c.similarity), int(k / c.similarity + 1e-9) - k
                for no, p in enumerate(c.cut(sizes[i : i + k], costs[i : i + k])):
                    if costs[i + p] < c.hot:
                        out.append((r, p, no, -1))
                    else:
                        out += [(r, p, no, s) for s in range(max(0, p - min(no, fewer)) // STRETCH, (p + min(no, more)) // STRETCH + 1)]
            r, p, no, stretch = np.array(out, np.int64).T
            k = key[at[r] + p]
            k = np.where(stretch < 0, k, _mixed(k, stretch))
            signed = [pa.array(x[r]) for x in _signature(h, at)]
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column("cls").take(pa.array(r)), pa.array(n[r].astype(np.int32)), *signed, pa.array(p.astype(np.int32)), pa.array(no.astype(np.int32))], ["key", "cls", "n", "sa", "sb", "pos", "no"])

    return rows.mapInArrow(cut, "key bigint, cls bigint, n int, sa bigint, sb bigint, pos int, no int")


def _training_substrings(rows: DataFrame, cutter, marks) -> DataFrame:
    """(key, cls, n, sa, sb, pos): the substring at each place of each training record, if an evaluation segment has its mark."""

    def cut(batches):
        c, bits = cutter.value, marks.value
        seen: set[int] = set()
        for batch in batches:
            # Of copies in one task one is enough.
            new = [i for i, name in enumerate(batch.column("cls").to_pylist()) if name not in seen and not seen.add(name)]
            if len(seen) > SEEN:
                seen.clear()
            batch = batch.take(pa.array(new, pa.int32()))
            h, n, at = _flat(batch)
            if not len(h):
                continue
            last = np.zeros(len(h), bool)
            last[at + n - 1] = True
            key, size, cost = c.places(h, last)
            r = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(h)) - at[r]
            key = np.where(cost < c.hot, key, _mixed(key, pos // STRETCH))
            keep = np.flatnonzero((size > 0) & _marked(bits, key))
            r = r[keep]
            signed = [pa.array(x[r]) for x in _signature(h, at)]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), batch.column("cls").take(pa.array(r)), pa.array(n[r].astype(np.int32)), *signed, pa.array(pos[keep].astype(np.int32))], ["key", "cls", "n", "sa", "sb", "pos"])

    return rows.mapInArrow(cut, "key bigint, cls bigint, n int, sa bigint, sb bigint, pos int")


def _marks(segments: DataFrame) -> np.ndarray:
    """Bits of the evaluation segments' keys: at most 2 ** MARK_BITS rows come to the driver."""
    slots = segments.select(F.col("key").bitwiseAND((1 << MARK_BITS) - 1).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bits = np.zeros(1 << MARK_BITS, bool)
    bits[slots] = True
    return np.packbits(bits)


def _marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & ((1 << MARK_BITS) - 1)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _verify(pairs: DataFrame, similarity: float) -> DataFrame:
    def check(batches):
        for batch in batches:
            lists = [batch.column(c) for c in ("words_e", "words_t")]
            codes, _ = pd.factorize(pa.concat_arrays([x.flatten() for x in lists]).to_numpy(zero_copy_only=False))
            ends = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in lists]
            cut = int(ends[0][-1])
            e, t = (np.split(c, i[1:-1]) for c, i in zip((codes[:cut], codes[cut:]), ends))
            common = common_in_order(e, t, [_least(max(len(x), len(y)), similarity) for x, y in zip(e, t)])
            keep = pa.array(np.flatnonzero(common))
            yield pa.RecordBatch.from_arrays([batch.column("cls_e").take(keep), batch.column("cls_t").take(keep), pa.array(common[common > 0])], ["cls_e", "cls_t", "common"])

    return pairs.mapInArrow(check, "cls_e bigint, cls_t bigint, common int")


def normal_tokens(tokens: Column) -> Column:
    """Tokens without regard to letter case; a null token counts as an empty one."""
    return F.transform(tokens, lambda t: F.coalesce(F.lower(t), F.lit("")))


def near_same(df: DataFrame, key: str = "example_id", split: str = "split_name", tokens: str = "tokens", train: str = "train", similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Membership (key, split, cls, n, source columns kept) and links (cls_e, cls_t, common) between classes of different tokens.

    Records with null tokens or splits, and of fewer than ``min_tokens``, have no class. Equal token lists are one class;
    links of a class to itself are not listed. Repeated rows are members each. Splits other than ``train`` are evaluation.
    Other columns are kept but for those named as one of the result's own.
    A similarity for which short records have fewer than K+1 tokens is a ValueError.
    """
    spark = df.sparkSession
    ship(spark)
    rest = [c for c in df.columns if c not in (key, split, tokens) and c.lower() not in ("key", "split", "cls", "n")]
    x = df.select(df[key].alias("key"), df[split].alias("split"), normal_tokens(df[tokens]).alias("words"), *[df[c].alias(f"_{c}") for c in rest])
    x = x.where(f"words is not null and split is not null and size(words) >= {int(min_tokens)}")
    # A class is named by two hashes of the whole list; tokens themselves are not shuffled until pairs are known.
    x = x.withColumn("cls", F.xxhash64(F.xxhash64("words"), F.hash("words"))).withColumn("n", F.size("words"))
    members = x.select("key", "split", "cls", "n", *[F.col(f"_{c}").alias(c) for c in rest])
    rows = x.select("cls", "words", (F.col("split") == train).alias("is_train"))
    cutter = spark.sparkContext.broadcast(Cutter(_sketch(rows), similarity, min_tokens))  # 2 ** SKETCH_BITS numbers
    hashed = rows.select("cls", "is_train", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # Copies of evaluation records give the same segments, which are kept once; copies of training records are handed on at
    # most once by each task, so they are not shuffled a second time to be found.
    e = materialize(_evaluation_segments(hashed.where("not is_train").select("cls", "hashes"), cutter).distinct())
    marks = spark.sparkContext.broadcast(_marks(e))  # 2 ** MARK_BITS bits
    t = _training_substrings(hashed.where("is_train").select("cls", "hashes"), cutter, marks)
    e, t = (y.select("key", *[F.col(c).alias(f"{c}_{s}") for c in y.columns if c not in ("key", "no")], *[c for c in y.columns if c == "no"]) for y, s in ((e, "e"), (t, "t")))
    need = F.ceil(F.lit(similarity) * F.greatest("n_e", "n_t") - F.lit(1e-9))
    shift, longer = F.col("pos_t") - F.col("pos_e"), F.col("n_t") - F.col("n_e")
    left, right = F.abs(shift) <= F.col("no"), F.abs(longer - shift) <= F.col("n_e") + F.col("n_t") - 2 * need - F.col("no")
    differing = F.bit_count(F.col("sa_e").bitwiseXOR(F.col("sa_t"))) + F.bit_count(F.col("sb_e").bitwiseXOR(F.col("sb_t"))) <= F.col("n_e") + F.col("n_t") - 2 * need
    met = (F.col("cls_e") != F.col("cls_t")) & (F.least("n_e", "n_t") >= need) & differing & left & (F.pmod(shift + F.col("no"), F.lit(2)) == 0) & right
    pairs = materialize(e.join(t, "key").where(met).select("cls_e", "cls_t").distinct())
    wanted = pairs.select(F.col("cls_e").alias("cls")).unionByName(pairs.select(F.col("cls_t").alias("cls"))).distinct()
    words = rows.select("cls", "words").join(small_side(wanted, LOOKUP_CLASSES), "cls", "left_semi").groupBy("cls").agg(F.first("words").alias("words"))
    full = pairs.join(words.select(F.col("cls").alias("cls_e"), F.col("words").alias("words_e")), "cls_e").join(words.select(F.col("cls").alias("cls_t"), F.col("words").alias("words_t")), "cls_t")
    return members, materialize(_verify(full, similarity))


def classes(members: DataFrame, links: DataFrame, train: str = "train") -> DataFrame:
    """(key, split, cls, links): each record with its class and the number of classes on the other side that it is near-same to.

    Its own class counts if it stands on the other side too. This form grows with the records and links, not with copies.
    """
    m = members.withColumn("side", F.col("split") == train)
    both = m.groupBy("cls").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("cls", F.explode(F.array(F.lit(True), F.lit(False))).alias("side"))
    every = links.select(F.col("cls_e").alias("cls"), F.lit(False).alias("side")).unionByName(links.select(F.col("cls_t").alias("cls"), F.lit(True).alias("side"))).unionByName(both)
    return m.join(every.groupBy("cls", "side").agg(F.count("*").alias("links")), ["cls", "side"], "left").select("key", "split", "cls", F.coalesce("links", F.lit(0)).alias("links"))


def pairs_of(members: DataFrame, links: DataFrame, train: str = "train") -> DataFrame:
    """(key_e, key_t): each evaluation record with each near-same training record, equal ones included."""
    e = members.where(F.col("split") != train).select(F.col("key").alias("key_e"), F.col("cls").alias("cls_e")).distinct()
    t = members.where(F.col("split") == train).select(F.col("key").alias("key_t"), F.col("cls").alias("cls_t")).distinct()
    same = e.join(t, e.cls_e == t.cls_t).select("key_e", "key_t")
    near = links.join(e, "cls_e").join(t, "cls_t").select("key_e", "key_t")
    return same.unionByName(near).where("key_e <> key_t").distinct()


def report(members: DataFrame, links: DataFrame, source: str = "source", train: str = "train") -> DataFrame:
    """(split, source, records, exact, near): evaluation records by split and source, and how many train has equally or almost."""
    in_train = members.where(F.col("split") == train).select("cls").distinct().withColumn("exact", F.lit(1))
    near = links.select(F.col("cls_e").alias("cls")).distinct().withColumn("near", F.lit(1))
    e = members.where(F.col("split") != train).join(in_train, "cls", "left").join(near, "cls", "left")
    return e.groupBy("split", F.col(source).alias("source")).agg(F.count("*").alias("records"), F.count("exact").alias("exact"), F.count(F.when(F.col("exact").isNull(), F.col("near"))).alias("near"))
