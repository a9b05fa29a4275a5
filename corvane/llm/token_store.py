"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Layout of a store, all integers little-endian:

``<shard>.ids``   raw ids of documents in ascending doc_id order, two bytes each where the
                  vocabulary has at most 65,536 ids, else four. Nothing else: byte 2 * k (or 4 * k) is id k.
``<bucket>.mph``  the entries of the keys that hash to this bucket, at their minimal perfect hash:
                  a 32-bit fingerprint of the key, the shard's number, the first id there, the count.
``<block>.dir``   a record of fixed size for every shard of a block of ranges: ids before it, its ids,
                  its file's name. A shard's number is its block and its place there.
``store.json``    width, buckets, ids, documents and shards.

Shards are written by range of doc_id, so concatenating them in order gives the whole corpus in
order. Looking a key up takes one hash, one bit vector rank and two ranged reads, of its shard's
record and of its ids; a key that was never written is refused by its fingerprint (up to one in 2^32).

A repeated doc_id is told apart by its occurrence number, counted from 0 in the order of the texts.
A null doc_id has keys of its own and sorts first.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import tokens
from corvane.llm.common import bounded_batches, materialize, scratch, splitmix

#: UTF-8 bytes of text per shard, on average, and the most ids in one file: bound what a task holds.
SHARD_TEXT_BYTES = 24 << 20
SHARD_IDS = 8 << 20
#: Keys per index bucket, on average.
KEYS_PER_BUCKET = 200_000
#: Bits per remaining key in each level of the hash.
_GAMMA = 2
_MAGIC = b"TIDX0001"
#: Ranges of doc_id whose shards share a directory file; the driver gets one row per that many.
DIRECTORY_PARTS = 1024
_SHARD = "<QQ64s"  # ids before, ids, file
_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u8"), ("start", "<u8"), ("count", "<u8")])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path there. ``file:/x`` and ``file:///x`` are the same."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _write(path: str, data: bytes) -> None:
    fs, at = _place(path)
    with fs.open_output_stream(at) as f:
        f.write(data)


def _read(path: str, start: int = 0, length: int | None = None) -> bytes:
    fs, at = _place(path)
    with fs.open_input_file(at) as f:
        return f.read_at(length if length is not None else f.size() - start, start)


def key_hash(keys: np.ndarray, nulls: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    """64 bits of each (doc_id, is null, occurrence)."""
    h = splitmix(np.asarray(keys, np.int64).view(np.uint64) ^ np.where(nulls, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0)))
    return splitmix(h + np.asarray(occurrences).astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bit vectors, each key at the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed little-endian bit vectors as 64-bit words
        self.ranks = []
        total = 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.n = total

    @staticmethod
    def _at(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return splitmix(keys + np.uint64((level + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            words = max(1, -(-_GAMMA * len(keys) // 64))
            at = cls._at(keys, len(levels), words).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            keys = keys[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for some keys that weren't there."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = self._at(keys[left], level, len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = ((words[word] >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[level][word] + below)[hit]
            left = left[~hit]
        return out


def dump_index(keys: np.ndarray, shards: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """An index file's bytes."""
    mph = PerfectHash.build(keys)
    entries = np.zeros(len(keys), _ENTRY)
    at = mph.find(keys)
    entries["fingerprint"][at] = (splitmix(keys) >> np.uint64(32)).astype("<u4")
    entries["shard"][at], entries["start"][at], entries["count"][at] = shards, starts, counts
    head = struct.pack("<8sQI", _MAGIC, len(keys), len(mph.levels)) + b"".join(struct.pack("<Q", len(x)) for x in mph.levels)
    return head + b"".join(x.astype("<u8").tobytes() for x in mph.levels) + entries.tobytes()


class Index:
    """A read index file: constant-time lookup of key hashes."""

    def __init__(self, data: bytes):
        magic, self.n, levels = struct.unpack_from("<8sQI", data)
        if magic != _MAGIC:
            raise ValueError("not an index file")
        at = struct.calcsize("<8sQI")
        sizes = struct.unpack_from(f"<{levels}Q", data, at)
        at += 8 * levels
        words = []
        for n in sizes:
            words.append(np.frombuffer(data, "<u8", n, at).astype(np.uint64))
            at += 8 * n
        self.mph = PerfectHash(words)
        self.entries = np.frombuffer(data, _ENTRY, self.n, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of keys, and whether each was found."""
        at = self.mph.find(keys)
        ok = at >= 0
        got = self.entries[np.where(ok, at, 0)] if self.n else np.zeros(len(keys), _ENTRY)
        return got, ok & (got["fingerprint"] == (splitmix(keys) >> np.uint64(32)).astype("<u4"))


class _ShardFile:
    """Ids written so far go straight to the file; its name holds the attempt, so a lost or repeated task can't touch it."""

    def __init__(self, root: str, name: str):
        self.name, self.ids = name, 0
        fs, at = _place(f"{root}/{name}")
        fs.create_dir(at.rpartition("/")[0])
        self.out = fs.open_output_stream(at)

    def put(self, data: bytes, n: int) -> None:
        self.out.write(data)
        self.ids += n


def write_store(docs: DataFrame, tokenizer: str | None = None, root: str | None = None) -> tuple[str, DataFrame]:
    """Encode and write ``docs`` (doc_id, text); returns the store's root and the keys written (doc_id, occurrence).

    Null text counts as empty: the end id alone. An empty table gives a store without shards.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    root = root or scratch(spark, "tokens")
    tokenizer = tokenizer or tokens.default_tokenizer()
    width = 2 if tokens.load(tokenizer).get_vocab_size() <= 1 << 16 else 4
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_TEXT_BYTES), min(spark.sparkContext.defaultParallelism, size >> 20))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, roll, file = task.partitionId(), 0, None
        last, occurrence = object(), 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(tokenizer, batch.column(1)), strict=True):
                n = len(ids)
                occurrence, last = (occurrence + 1 if doc == last else 0), doc
                if file is None or file.ids + n > SHARD_IDS and file.ids:
                    if file is not None:
                        file.out.close()
                    roll += 1
                    file = _ShardFile(root, f"{part:06d}-{roll:04d}-{task.taskAttemptId()}.ids")
                for col, v in zip(out, (doc, occurrence, part, file.name, file.ids, n), strict=True):
                    col.append(v)
                file.put(ids.astype("<u2" if width == 2 else "<u4").tobytes(), n)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "occurrence", "part", "file", "start", "count"])
        if file is not None:
            file.out.close()

    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    entries = materialize(ordered.mapInArrow(write, "doc_id long, occurrence long, part int, file string, start long, count long"), "entries")

    per_file = entries.groupBy("part", "file").agg(F.sum("count").alias("ids"), F.count("*").alias("docs"))
    per_file = per_file.withColumn("block", F.floor(F.col("part") / DIRECTORY_PARTS).cast("long"))
    in_order = Window.partitionBy("block").orderBy("part", "file")
    before = F.coalesce(F.sum("ids").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = materialize(per_file.withColumns({"place": F.row_number().over(in_order) - 1, "before": before}), "shards")
    # One row per DIRECTORY_PARTS ranges reaches the driver: 24 GB of text each.
    blocks = listed.groupBy("block").agg(F.sum("ids").alias("ids"), F.sum("docs").alias("docs"), F.count("*").alias("shards")).orderBy("block").collect()
    n = sum(b["docs"] for b in blocks)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    ends = np.cumsum([0, *(b["ids"] for b in blocks)]).tolist()

    def directory(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        _write(f"{root}/{int(key[0]):06d}.dir", b"".join(struct.pack(_SHARD, *r) for r in zip(pdf["before"] + pdf["ahead"], pdf["ids"], pdf["file"].str.encode("ascii"), strict=True)))
        return pd.DataFrame({"block": [int(key[0])], "shards": [len(pdf)]})

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = key_hash(pdf["doc_id"].to_numpy(), pdf["null"].to_numpy(), pdf["occurrence"].to_numpy())
        _write(f"{root}/{int(key[0]):06d}.mph", dump_index(h, pdf["shard"].to_numpy(), pdf["start"].to_numpy(), pdf["count"].to_numpy()))
        return pd.DataFrame({"bucket": [int(key[0])], "keys": [len(pdf)]})

    _place(root)[0].create_dir(_place(root)[1])
    if n:
        ahead = spark.createDataFrame([(b["block"], e) for b, e in zip(blocks, ends[:-1], strict=True)], "block long, ahead long")
        written = listed.join(ahead, "block").groupBy("block").applyInPandas(directory, "block long, shards long")
        keyed = entries.join(listed.select("file", (F.shiftleft("block", 32) + F.col("place")).alias("shard")), "file")
        keyed = with_bucket(keyed, buckets).groupBy("bucket").applyInPandas(index, "bucket long, keys long")
        if written.agg(F.sum("shards")).first()[0] != sum(b["shards"] for b in blocks) or keyed.agg(F.sum("keys")).first()[0] != n:
            raise RuntimeError("the index doesn't hold every document")
    meta = {"width": width, "buckets": buckets, "ids": ends[-1], "documents": n, "shards": sum(b["shards"] for b in blocks)}
    _write(f"{root}/store.json", json.dumps(meta).encode())
    return root, entries.select("doc_id", "occurrence")


def with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    """Add the index bucket and a filled doc_id to keys (doc_id, occurrence)."""
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(buckets)).cast("long")).withColumn("null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))


def read_meta(root: str) -> dict:
    """What ``store.json`` holds; the shards as a range over their count."""
    meta = json.loads(_read(f"{root}/store.json"))
    return meta | {"shards": range(meta["shards"])}


def read_shard(root: str, shard: int) -> tuple[int, int, str]:
    """A shard's record by one ranged read: ids before it, its ids, its file."""
    size = struct.calcsize(_SHARD)
    before, ids, name = struct.unpack(_SHARD, _read(f"{root}/{shard >> 32:06d}.dir", (shard & 0xFFFFFFFF) * size, size))
    return before, ids, name.rstrip(b"\0").decode("ascii")


def lookup(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Find keys (doc_id, occurrence) through the index: doc_id, occurrence, shard, start there, count. Keys that the store lacks give no row."""
    meta = read_meta(root)

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entry, ok = Index(_read(f"{root}/{int(key[0]):06d}.mph")).find(key_hash(pdf["doc_id"].to_numpy(), pdf["null"].to_numpy(), pdf["occurrence"].to_numpy()))
        out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").mask(pdf["null"]), "occurrence": pdf["occurrence"], "shard": entry["shard"].astype(np.int64), "start": entry["start"].astype(np.int64), "count": entry["count"].astype(np.int64)})
        return out[ok]

    schema = "doc_id long, occurrence long, shard long, start long, count long"
    if not meta["documents"]:
        return spark.createDataFrame([], schema)
    return with_bucket(keys, meta["buckets"]).groupBy("bucket").applyInPandas(find, schema)


def read_documents(spark: SparkSession, root: str, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read documents back by key: doc_id, start (ids of all before), n_tokens, ids_crc32 and, if asked for, ids."""
    meta = read_meta(root)
    width, kind = meta["width"], f"<u{meta['width']}"

    def read(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        before, _, file = read_shard(root, int(key[0]))
        data = _read(f"{root}/{file}")
        spans = [np.frombuffer(data, kind, n, at * width).astype("<u4") for at, n in zip(pdf["start"], pdf["count"], strict=True)]
        out = pd.DataFrame({"doc_id": pdf["doc_id"], "start": pdf["start"] + before, "n_tokens": pdf["count"], "ids_crc32": [zlib.crc32(x.tobytes()) for x in spans]})
        if with_ids:
            out["ids"] = [x.astype(np.int64) for x in spans]
        return out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return lookup(spark, root, keys).groupBy("shard").applyInPandas(read, schema)


def read_one(root: str, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
    """One document's ids by four reads: the store's figures, its index bucket, its shard's record, its span. None if it isn't there."""
    meta = read_meta(root)
    if not meta["documents"]:
        return None
    h = 42  # as xxhash64(doc_id, occurrence) in with_bucket, which passes over a null
    for x in (doc_id, occurrence):
        h = h if x is None else xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    bucket = (h - (h >> 63 << 64)) % meta["buckets"]
    entry, ok = Index(_read(f"{root}/{bucket:06d}.mph")).find(key_hash(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence])))
    if not ok[0]:
        return None
    at, n, w = int(entry["start"][0]), int(entry["count"][0]), meta["width"]
    return np.frombuffer(_read(f"{root}/{read_shard(root, int(entry['shard'][0]))[2]}", at * w, n * w), f"<u{w}")
