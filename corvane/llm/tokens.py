"""Byte-level BPE token ids at corpus speed.

The tokenizer is a public vocabulary file; its path is a parameter. Prose repeats words, so a batch
of texts is cut into space-led units, each distinct unit is looked up once among those that the
worker has met, and the ``tokenizers`` library is asked for new ones only. A text may be cut before
a space wherever the tokenizer's own pre-tokenization must cut too; texts where that isn't certain
(runs of white space with a space inside or at the end, the tokenizer's special strings) go to the
library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.anchors import Ranges
from corvane.llm.common import splitmix

#: Appended to each document.
END_ID = 2
#: Units kept by a worker, at about 40 bytes each; when there are more, the half that wasn't met for
#: the longest time goes. Bounds memory, changes no result.
CACHE_UNITS = 3_000_000
_LINES = 2_000
_WHITE = r"[\s\v\x{1c}-\x{1f}\x{85}\pZ]"
_UNSURE = rf"{_WHITE} (?:{_WHITE}|\z)| \z|\x{{0}}"
_NEWLINE = re.compile(r"(?<=\S)(\n)(?=\S)")
#: Leads the first unit of a text, which has no space before it.
_FIRST = "\x00"

_cache: dict[str, Units] = {}
_loaded: dict[str, object] = {}


def default_tokenizer() -> str:
    """The path of the public byte-level vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The tokenizer at ``path``, once per process and on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def encode_plain(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, straight from the library."""
    return [np.asarray(e.ids, dtype="<u4") for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


def _encode_lines(path: str, units: list[str]) -> dict[str, bytes]:
    """Ids of units without white space but a leading space: lines of one text, as a lone line break is a token of its own."""
    newline = encode_plain(path, ["\n"])[0]
    out: dict[str, bytes] = {}
    for lo in range(0, len(units), _LINES):  # few at once: the library keeps far more per token than its id
        some = units[lo : lo + _LINES]
        ids = encode_plain(path, ["\n".join(some) + "\n"])[0]
        ends = np.flatnonzero(ids == newline[0]) if len(newline) == 1 else []
        if len(ends) != len(some):
            out.update((u, x.tobytes()) for u, x in zip(some, encode_plain(path, some), strict=True))
            continue
        raw, at = ids.tobytes(), 0
        for u, end in zip(some, (4 * ends).tolist(), strict=True):
            out[u] = raw[at:end]
            at = end + 4
    return out


def _hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string, of 64 and 32 bits."""
    _, offsets, data = strings.buffers()
    cuts = np.frombuffer(offsets, "<i4")[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.empty(0, np.uint8)
    cuts = cuts.astype(np.int64) - int(cuts[0])
    n = (cuts[1:] - cuts[:-1]).astype(np.uint64)
    one, two = (splitmix(Ranges(code[raw]).hash(cuts[:-1], cuts[1:]) + n) for code in _CODES)
    return one, (two >> np.uint64(32)).astype(np.uint32)


_CODES = [splitmix(np.arange(256, dtype=np.uint64) + np.uint64(salt)) for salt in (0x1DEA, 0x7A11)]


class Units:
    """The ids of units met so far: a sorted table of hashes, and all ids one after another."""

    def __init__(self):
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int32)
        self.used, self.ids = np.empty(0, np.int32), np.empty(0, np.uint32)
        self.turn = 0

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and whether each unit is there."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        order = np.argsort(key)
        at = np.empty(len(key), np.int64)
        at[order] = np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)
        return at, (self.key[at] == key) & (self.check[at] == check)

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[bytes]) -> None:
        if len(self.key) + len(key) > CACHE_UNITS:
            self._forget()
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        begin = (len(self.ids) + np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        fresh = {"key": key, "check": check, "begin": begin, "size": size, "used": np.full(len(key), self.turn, np.int32)}
        for name, x in fresh.items():
            setattr(self, name, np.insert(getattr(self, name), at, x[order]))

    def _forget(self) -> None:
        stay = (self.used > np.median(self.used)) | (self.used == self.turn) if len(self.used) else np.empty(0, bool)
        size = self.size[stay]
        begin = np.cumsum(size, dtype=np.int64) - size
        self.ids = self.ids[np.repeat(self.begin[stay].astype(np.int64) - begin, size) + np.arange(int(size.sum()))]
        self.key, self.check, self.used, self.size, self.begin = self.key[stay], self.check[stay], self.used[stay], size, begin.astype(np.int32)


def _learn(path: str, new: list[str]) -> list[bytes]:
    """Ids of units, each given without its leading space, or with the mark of a first one."""
    lines: set[str] = set()
    other: set[str] = set()
    cut: dict[str, list[str]] = {}
    for u in new:
        if u.isprintable() and u and " " not in u:  # no white space at all
            lines.add(" " + u)
        else:
            cut[u] = [p for p in _NEWLINE.split(u[1:] if u[:1] == _FIRST else " " + u) if p]
            for p in cut[u]:
                (lines if p.isprintable() and p != " " and " " not in p[1:] else other).add(p)
    found = _encode_lines(path, list(lines)) if lines else {}
    found |= {p: x.tobytes() for p, x in zip(other, encode_plain(path, list(other)), strict=True)}
    return [b"".join([found[p] for p in cut[u]]) if u in cut else found[" " + u] for u in new]


def encode(path: str, texts: pa.Array, end: int | None = END_ID) -> list[np.ndarray]:
    """Ids of each text, as unsigned 32-bit integers; ``end`` is appended to each. Null counts as empty."""
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return []
    known = _cache.setdefault(path, Units())
    known.turn += 1
    whole = pc.match_substring_regex(texts, _UNSURE)
    for special in load(path).get_added_tokens_decoder().values():
        whole = pc.or_(whole, pc.match_substring(texts, special.content))
    alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    if len(alone):
        texts_cut = pc.if_else(whole, "", texts)
    else:
        texts_cut = texts
    split = pc.split_pattern(pc.binary_join_element_wise(_FIRST, texts_cut, ""), " ")
    units = split.flatten().dictionary_encode()
    key, check = _hashes(units.dictionary)
    at, met = known.find(key, check)
    if not met.all():
        new = np.flatnonzero(~met)
        known.used[at[met]] = known.turn
        known.add(key[new], check[new], _learn(path, units.dictionary.take(pa.array(new)).to_pylist()))
        at, met = known.find(key, check)
    known.used[at] = known.turn
    sizes = np.append(known.size[at], 0 if end is None else 1)
    begin = np.append(known.begin[at], len(known.ids)).astype(np.int64)
    flat = known.ids if end is None else np.append(known.ids, np.uint32(end))
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    index = np.insert(units.indices.to_numpy(), offsets[1:], len(sizes) - 1)
    offsets = offsets + np.arange(len(offsets))
    n = sizes[index]
    ends = np.cumsum(n, dtype=np.int64)
    ids = flat[np.repeat(begin[index] - (ends - n), n) + np.arange(int(ends[-1]))]
    cuts = np.concatenate([[0], ends])[offsets]
    out = [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
    if len(alone):
        tail = np.array([] if end is None else [end], "<u4")
        for i, x in zip(alone.tolist(), encode_plain(path, texts.take(pa.array(alone)).to_pylist()), strict=True):
            out[i] = np.concatenate([x, tail])
    return out
