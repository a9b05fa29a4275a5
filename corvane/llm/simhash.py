"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most r bits agree on one of r + 1 chunks of their bits, so each
distinct fingerprint goes to r + 1 groups, one per chunk value. A chunk value shared by very many
fingerprints is divided again by chunks of the bits that are left, and so on; at the last level
the bits left bound the group.

Groups are dealt over buckets. In a bucket, fingerprints are sorted by group and Gray rank, and a
tree is laid over them: each node holds the bit pattern that its members share beyond what its
parent holds. A search carries the differences counted so far down the tree and leaves a whole
node as soon as they exceed r, or when all its members are already known to be linked to the query.
A bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, materialize, splitmix, spread
from corvane.llm.components import connected_components

BITS = 64
SEED = 42
#: Members of a node.
FAN = 8
#: Fingerprints in one bucket, on average.
BUCKET = 40_000
#: A group of more fingerprints is divided by further chunks.
GROUP = 16_384
#: Bits fixed after which a group isn't divided any more: 2^20 fingerprints at most are left.
FIXED = 44
#: Bits in a band of a wide fingerprint, and how often its bits are dealt anew to bands.
BAND, DEALS = 11, 2
#: Texts are near copies from this share of their distinct shingles on: (4, 5) is 0.8.
SIMILAR = (4, 5)
#: Texts and shingles of a block of candidates that are compared exactly.
BLOCK_TEXTS, BLOCK_SHINGLES = 4_000, 2_000_000
#: Search states held at once.
_STATES = 1 << 20


def shingles(text: bytes, width: int = 4) -> np.ndarray:
    """Hashes of a text's word shingles, with repeats; words are runs free of ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n)


def fingerprint(text: bytes, width: int = 4, parts: int = 1) -> np.ndarray:
    """The SimHash of a text's word shingles.

    ``parts`` 64-bit numbers: the first from the shingles' own hashes, further ones from those scrambled.
    """
    return _fingerprint_of(shingles(text, width), parts)


def _fingerprint_of(h: np.ndarray, parts: int) -> np.ndarray:
    n = len(h)
    out = np.zeros(parts, np.uint64)
    for part in range(parts if n else 0):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 16):
            some = h[at : at + (1 << 16)]
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[part] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
        if part + 1 < parts:
            h = splitmix(h)
    return out


def fingerprints(docs: DataFrame, width: int = 4, parts: int = 1) -> DataFrame:
    """doc_id, hash (of the text) and fp, fp1, ... (the fingerprint's bits as longs) of every row; null text counts as empty."""
    bounded_batches(docs.sparkSession)
    names = ["fp", *(f"fp{k}" for k in range(1, parts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x or b"", width, parts) for x in batch.column(2).to_pylist()], np.uint64).reshape(-1, parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(fp[:, k]) for k in range(parts))], ["doc_id", "hash", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    return spread(slim, "doc_id").mapInArrow(run, ", ".join(["doc_id long", "hash long", *(f"{n} long" for n in names)]))


def set_fingerprints(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """doc_id, hash (of the text), shingle_set (a hash of the distinct shingles), size (their number) and fp, fp1, ... of those, of every row."""
    bounded_batches(docs.sparkSession)
    names = ["fp", *(f"fp{k}" for k in range(1, parts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(x or b"", width)) for x in batch.column(2).to_pylist()]
            fp = np.array([_fingerprint_of(x, parts) for x in sets], np.uint64).reshape(-1, parts).view(np.int64)
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(fp[:, k]) for k in range(parts))], ["doc_id", "hash", "shingle_set", "size", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    return spread(slim, "doc_id").mapInArrow(run, ", ".join(["doc_id long", "hash long", "shingle_set long", "size long", *(f"{n} long" for n in names)]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in Gray order; words of several numbers are read one after another."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    for k in range(1, x.shape[1] if x.ndim == 2 else 0):
        x[:, k] ^= np.where(x[:, k - 1] & np.uint64(1), ~np.uint64(0), np.uint64(0))  # the ones so far are odd in number
    return x


def _differences(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; label[i] stays the smallest index of i's class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class GrayIndex:
    """The tree over fingerprints (rows of one or more numbers) sorted by (group, Gray rank); one root per group."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        fp = fp.reshape(len(fp), -1)
        order = np.lexsort((*gray_rank(fp).T[::-1], group))
        self.order, self.fp = order, fp[order]
        group = group[order]
        m = len(fp)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, m))
        self.levels: list[tuple[np.ndarray, ...]] = []  # per level: first child, children, pattern, own mask, end member
        low, high, child_start, child_n = self.fp, self.fp, starts, sizes
        begin_of_child = np.arange(m)
        end_of_child = np.arange(1, m + 1)
        tree = []
        while True:  # group the children of each root by FAN; the children are members at first
            n = -(-child_n // FAN)
            first_node = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - first_node[of]
            first = child_start[of] + k * FAN
            count = np.minimum(FAN, child_n[of] - k * FAN)
            low, high = np.bitwise_and.reduceat(low, first, axis=0), np.bitwise_or.reduceat(high, first, axis=0)
            begin_of_child, end_of_child = begin_of_child[first], end_of_child[first + count - 1]
            tree.append((first, count, low, ~(low ^ high), begin_of_child, end_of_child))
            child_start, child_n = first_node, n
            if (n == 1).all():
                break
        tree.reverse()
        parent_mask = np.zeros((len(starts), fp.shape[1]), np.uint64)
        for at, (first, count, low, mask, begin, end) in enumerate(tree):
            if at:
                parent_mask = np.repeat(tree[at - 1][3], tree[at - 1][1], axis=0)
            self.levels.append((first, count, low, mask & ~parent_mask, begin, end))
        self.root = np.repeat(np.arange(len(starts)), sizes)

    def forest(self, r: int) -> np.ndarray:
        """For each member, in the order given to the index, the member that stands for its class."""
        fp, m = self.fp, len(self.fp)
        label = np.arange(m)
        for step in (1, 2, 4):  # most links stand close in Gray order
            a = np.arange(max(0, m - step))
            near = (self.root[a] == self.root[a + step]) & (_differences(fp[a] ^ fp[a + step]) <= r)
            _merge(label, a[near], a[near] + step)
        leaves = np.bincount(self.root) // FAN + 1
        cost = np.cumsum(leaves[self.root])
        at = 0
        while at < m:
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + _STATES, "right")))
            a, b = self._search(np.arange(at, to), r, label)
            _merge(label, a, b)
            at = to
        out = np.empty(m, np.int64)
        out[self.order] = self.order[label]
        return out

    def _search(self, q: np.ndarray, r: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, node, seen = self.fp, self.root[q], np.zeros(len(q), np.int64)
        for depth, (first, count, pattern, mask, begin, end) in enumerate(self.levels):
            seen = seen + _differences((fp[q] ^ pattern[node]) & mask[node])
            same = np.minimum.reduceat(label, begin) == np.maximum.reduceat(label, begin)
            linked = same[node] & (label[begin[node]] == label[q])
            stay = (seen <= r) & (end[node] > q + 1) & ~linked
            q, node, seen = q[stay], node[stay], seen[stay]
            n = count[node]
            child = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, seen, node = np.repeat(q, n), np.repeat(seen, n), child
            if depth == len(self.levels) - 1:
                hit = (child > q) & (label[child] != label[q])
                q, child = q[hit], child[hit]
                near = _differences(fp[q] ^ fp[child]) <= r
                return q[near], child[near]
        raise AssertionError


def _chunks(used: int, pieces: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``pieces`` near-equal runs of ``BITS - used`` bits, counted on what is left."""
    left = BITS - used
    cuts = [left * k // pieces for k in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(distinct: DataFrame, r: int = 4, bucket: int = BUCKET, group: int = GROUP, fixed: int = FIXED) -> DataFrame:
    """A spanning forest (a, b) of the pairs of fingerprints (fp) within ``r`` bits.

    ``left`` is the fingerprint without the bits that its group fixes, so dividing again always
    takes bits that are still free. Every division keeps each pair within r bits together in at
    least one group.
    """
    rows = distinct.select("fp", F.lit(0).cast("long").alias("grp"), F.col("fp").alias("left"))
    used, done = 0, []
    while True:
        parts = []
        for k, (shift, bits) in enumerate(_chunks(used, r + 1)):
            value = F.shiftrightunsigned("left", shift).bitwiseAND(F.lit((1 << bits) - 1))
            below = F.col("left").bitwiseAND(F.lit((1 << shift) - 1))
            above = F.shiftleft(F.shiftrightunsigned("left", shift + bits), shift) if shift + bits < BITS else F.lit(0).cast("long")
            parts.append(F.struct(F.xxhash64("grp", F.lit(k), value).alias("grp"), below.bitwiseOR(above).alias("left"), F.lit(bits).alias("bits")))
        rows = rows.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.grp", "p.left")
        used += min(bits for _, bits in _chunks(used, r + 1))
        if used >= fixed:
            done.append(rows)
            break
        hot = rows.groupBy("grp").count().filter(F.col("count") > group).select("grp")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, "grp", "left_anti").select("fp", "grp", "left"))
        rows = materialize(rows.join(hot, "grp", "left_semi").select("fp", "grp", "left"), "hot")
    out = None
    n = distinct.count() * (r + 1)
    buckets = max(1, -(-n // bucket))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        to = GrayIndex(pdf["grp"].to_numpy(), fp).forest(r)
        moved = np.flatnonzero(to != np.arange(len(to)))
        return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[to[moved]].view(np.int64)})

    for part in done:
        out = part.select("fp", "grp") if out is None else out.unionByName(part.select("fp", "grp"))
    return out.groupBy(F.pmod("grp", F.lit(buckets)).alias("bucket")).applyInPandas(forest, "a long, b long")


def _bands(parts: int, band: int, deals: int) -> np.ndarray:
    """The bits of each band: every deal shuffles all bits and cuts them into bands."""
    rng, bits = np.random.default_rng(SEED), BITS * parts
    return np.concatenate([rng.permutation(bits)[: bits // band * band].reshape(-1, band) for _ in range(deals)])


def band_links(distinct: DataFrame, parts: int, r: int, band: int = BAND, deals: int = DEALS, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """A spanning forest (a, b) over ids (id) of pairs of wide fingerprints within ``r`` bits that agree on a band.

    Bands are ``band`` bits from anywhere in the fingerprint. A band value of very many fingerprints is
    divided into blocks, and all pairs of its blocks are searched.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, parts))]
    cuts = _bands(parts, band, deals)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([batch.column(k + 1).to_numpy() for k in range(parts)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
            value = bits[:, cuts].astype(np.int64) @ (1 << np.arange(band)) + (np.arange(len(cuts)) << band)
            row = pa.array(np.repeat(np.arange(len(fp)), len(cuts)))
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns), pa.array(value.ravel())], ["id", *names, "grp"])

    rows = distinct.select("id", *names).mapInArrow(deal, ", ".join(f"{c} long" for c in ("id", *names, "grp")))
    sizes = rows.groupBy("grp").count().filter(F.col("count") > group)
    if sizes.isEmpty():
        rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    else:
        rows = rows.join(sizes.select("grp", F.ceil(F.col("count") / group).cast("int").alias("blocks")), "grp", "left").fillna(1, ["blocks"])
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    rows = rows.select("id", *names, F.xxhash64("grp", "lo", "hi").alias("grp"))
    buckets = max(1, -(-distinct.count() * len(cuts) // bucket))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        to = GrayIndex(pdf["grp"].to_numpy(), pdf[names].to_numpy().astype(np.int64).view(np.uint64)).forest(r)
        moved = np.flatnonzero(to != np.arange(len(to)))
        return pd.DataFrame({"a": ids[moved], "b": ids[to[moved]]})

    return rows.groupBy(F.pmod("grp", F.lit(buckets)).alias("bucket")).applyInPandas(forest, "a long, b long")


def similar_forest(sets: list[np.ndarray], fp: np.ndarray, r: int) -> np.ndarray:
    """For each set the smallest index of its class over pairs within ``r`` bits whose Jaccard similarity is ``SIMILAR`` or more."""
    label, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    part, whole = SIMILAR
    for i in range(1, len(sets)):
        bits = _differences(fp[:i] ^ fp[i])
        near = np.flatnonzero((bits <= r) & (np.minimum(size[:i], size[i]) * whole >= np.maximum(size[:i], size[i]) * part))
        near = near[np.argsort(bits[near], kind="stable")]
        while len(near):
            j, near = near[0], near[1:]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * whole >= (size[i] + size[j] - both) * part:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label[label == old] = new
                near = near[label[near] != label[i]]
    return label


def similar_links(docs: DataFrame, candidates: DataFrame, width: int, parts: int, r: int, texts: int = BLOCK_TEXTS, total: int = BLOCK_SHINGLES) -> DataFrame:
    """A spanning forest (a, b) over ids of the pairs of one component whose distinct shingles are similar.

    ``candidates`` has id, component, size, the fingerprint and the text's key (least). A component of
    very many texts or shingles is divided into blocks, and all pairs of its blocks are compared.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, parts))]
    sizes = candidates.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / texts), F.ceil(F.sum("size") / total), F.lit(1)).cast("int").alias("blocks"))
    rows = candidates.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    amount = rows.agg(F.sum(F.col("size") * F.greatest(F.lit(1), F.col("blocks") - 1))).first()[0] or 0
    buckets = max(1, -(-amount // total))
    keys = rows.select("id", "component", "own", other.alias("other"), *names, F.col("least.doc_id").alias("_id"), F.col("least.hash").alias("_hash"))
    slim = docs.select(F.col("doc_id").cast("long").alias("_own"), F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text"))
    found = slim.join(keys, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))).dropDuplicates(["id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(x or b"", width)).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], ["sets", *batch.schema.names[1:]])

    longs = ["id", "component", *names]
    rows = found.select("text", *longs, "own", "other").mapInArrow(cut, ", ".join(["sets binary", *(f"{c} long" for c in longs), "own int", "other array<int>"]))
    rows = rows.withColumn("other", F.explode("other"))
    rows = rows.select("sets", "id", *names, F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, one in pdf.groupby("unit", sort=False):
            ids = one["id"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in one["sets"]]
            to = similar_forest(sets, one[names].to_numpy().astype(np.int64).view(np.uint64), r)
            moved = np.flatnonzero(to != np.arange(len(to)))
            a.append(ids[moved])
            b.append(ids[to[moved]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy(F.pmod("unit", F.lit(buckets)).alias("bucket")).applyInPandas(forest, "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, parts: int = 4, r: int = 68) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group, the one of smallest doc_id stays.

    Near copies have a Jaccard similarity of 0.8 or more of their distinct word shingles; groups are
    chains of them. Fingerprints of 256 bits only find candidates: at similarity J two texts differ in
    a share of about arccos(2J / (1 + J)) / pi of the bits, 39 give or take 6 for 0.8, and up to 48 if
    they have only a few shingles. Candidates are within ``r`` bits and agree on one of 46 bands of 11
    bits, which at that similarity 99.9 % of pairs do (99 % of those of a few shingles). Within each
    component of candidates the shingles themselves are then compared, so no pair below 0.8 links.

    All columns stay. Of rows that repeat one id and text, one stays; a null id counts as the largest.
    """
    own = materialize(set_fingerprints(docs, width, parts), "fingerprints")
    names = [c for c in own.columns if c not in ("doc_id", "hash")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "hash")).alias("least")
    distinct = materialize(own.groupBy(*names).agg(first).withColumn("id", F.monotonically_increasing_id()), "distinct")
    rough = connected_components(band_links(distinct, parts, r)).select(F.col("node").alias("id"), "component")
    candidates = materialize(distinct.join(rough, "id"), "candidates")
    classes = connected_components(similar_links(docs, candidates, width, parts, r)).select(F.col("node").alias("id"), "component")
    classed = distinct.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stay = classed.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.hash").alias("_hash"))
    marked = docs.withColumns({"__own": F.col("doc_id").cast("long"), "__text": F.xxhash64("text")})
    marked = marked.join(stay, F.col("__own").eqNullSafe(F.col("_id")) & (F.col("__text") == F.col("_hash")), "left_semi")
    return marked.dropDuplicates(["__own", "__text"]).drop("__own", "__text")


def near_duplicates(docs: DataFrame, width: int = 4, r: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable over links of at most ``r`` bits.

    Fingerprints of equal value always link, that of empty texts (zero) as well. Repeated rows are
    documents of their own. Where a component has no doc_id but null, its component_id is null. An
    empty table gives no rows; further columns of ``docs`` are ignored.
    """
    own = materialize(fingerprints(docs, width).drop("hash"), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = connected_components(links(distinct, r)).select(F.col("node").alias("fp"), "component")
    classed = distinct.join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.join(classed.join(least, "component").select("fp", "component", "component_id"), "fp")
