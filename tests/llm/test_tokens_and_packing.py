from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from messy_tables import with_clashes
from tokenizers import Tokenizer

from corvane.llm import packing, token_store, tokens

PATH = tokens.default_tokenizer()


def library(texts: list[str]) -> list[np.ndarray]:
    """Ids straight from the tokenizers library, then the end id."""
    plain = Tokenizer.from_file(PATH)
    return [np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(1)
    parts = [" ", " ", "\n", "\t", "a", "bc", "'s", ",", ".", "!!", "7", "é", "\u00a0", "\u200b", "\x1c", "\r", "日本", "\x00"]
    fixed = ["", " ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b.", "x\u2003y z", "it's  it'll, don't.\n\nOK", "<|endoftext|> x <|endoftext|>", "foo \nbar", "\x00 a\x00"]
    return fixed + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(n)]


def test_cached_encoding_equals_the_library(monkeypatch):
    texts = odd_texts(1500)
    expected = [x[:-1].tolist() for x in library(texts)]
    tokens._cache.clear()
    assert [x.tolist() for x in tokens.encode(PATH, texts, None)] == expected
    assert [x.tolist() for x in tokens.encode(PATH, texts)] == [[*x, tokens.END_ID] for x in expected]
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)  # the table forgets all the time
    tokens._cache.clear()
    for lo in range(0, len(texts), 40):
        assert [x.tolist() for x in tokens.encode(PATH, texts[lo : lo + 40], None)] == expected[lo : lo + 40]
    assert tokens.encode(PATH, []) == []


def test_sum_of_squares_is_the_greedy_choice():
    rng = np.random.default_rng(0)
    lengths, capacity = rng.integers(1, 20, 300), 20
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    gaps, number = [], {}
    for size, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        count = np.bincount([g for g in gaps if g > 0], minlength=capacity + 1)

        def cost(frm, to):
            c = count.copy()
            if frm:
                c[frm] -= 1
            if to:
                c[to] += 1
            return int((c**2).sum())

        options = {g: cost(g, g - size) for g in set(gaps) if g >= size}
        options[None] = cost(0, capacity - size)
        taken = None if b not in number else gaps[number[b]]
        assert options[taken] == min(options.values())
        if taken is None:
            number[b] = len(gaps)
            gaps.append(capacity - size)
            assert o == 0
        else:
            assert o == capacity - taken
            gaps[number[b]] -= size


@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 2048, 5000])
def test_cut(n):
    pieces = packing.cut(n, 1024)
    assert sum(k for _, k in pieces) == n and all(k <= 1024 for _, k in pieces)
    assert [at for at, _ in pieces] == np.cumsum([0, *(k for _, k in pieces)])[:-1].tolist()
    assert all(k == 1024 for _, k in pieces[1:])


def test_packing_holds_every_piece_once(spark, messy):
    docs = with_clashes(messy)
    out = packing.pack_documents(docs, capacity=64).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in messy.collect()]
    expected = defaultdict(int)
    for (doc, _), ids in zip(texts, library([t for _, t in texts]), strict=True):
        for k, (at, n) in enumerate(packing.cut(len(ids), 64)):
            expected[doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in out:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0, *(n for _, n in p)])[:-1].tolist() and p[-1][0] + p[-1][1] <= 64
    total = sum(k[3] * v for k, v in expected.items())
    assert len(places) <= 1.02 * total / 64 + 2


def test_packing_nothing(spark, nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_few_sequences_are_wasted():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1023, rng.exponential(500, 20000).astype(int) + 1)
    bins, offsets = packing.pack_lengths(lengths, 1024)
    used = np.bincount(bins, lengths)
    assert used.max() <= 1024 and (bins.max() + 1) <= 1.005 * lengths.sum() / 1024


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    for some in (keys[:0], keys[:1], keys):
        mph = token_store.PerfectHash.build(some)
        assert sorted(mph.find(some).tolist()) == list(range(len(some)))


def test_store_round_trip(spark, messy, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 1000)
    monkeypatch.setattr(token_store, "SHARD_TEXT_BYTES", 4000)
    monkeypatch.setattr(token_store, "DIRECTORY_PARTS", 2)
    docs = with_clashes(messy)
    root, keys = token_store.write_store(docs, root=f"file://{tmp_path}/store")
    rows = [(r["doc_id"], r["text"] or "") for r in messy.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, expected = 0, []
    for (doc, _), ids in zip(order, library([t for _, t in order]), strict=True):
        expected.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_store.read_documents(spark, root, keys, with_ids=True).collect()
    assert len(token_store.read_meta(root)["shards"]) > 1 and len(list((tmp_path / "store").glob("*.dir"))) > 1

    def known(rows):  # the order of equal ids is that of the texts, nulls as empty
        return sorted(rows, key=str)

    assert known((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == known(expected)
    one = token_store.read_one(root, 9)
    assert one.tolist() == library(["Ünï 日本 🙂 " * 60])[0].tolist()
    assert token_store.read_one(root, 2, 1).tolist() == token_store.read_one(root, 2, 0).tolist()
    assert token_store.read_one(root, 424242) is None and token_store.read_one(root, 2, 2) is None


def test_empty_store(spark, nothing):
    root, keys = token_store.write_store(nothing)
    assert token_store.read_documents(spark, root, keys).count() == 0 and token_store.read_one(root, 1) is None
