"""URL filtering by a bit-parallel automaton over many glob rules at once.

A URL is brought to the form host + path. Every rule becomes globs over that form; all globs sit
side by side in multiword Shift-And masks: one bit per pattern position. One step per character
advances every pattern for every URL of a batch, so the cost doesn't depend on which rules match.

Globs: ``*`` is any run without a slash, ``**`` any run, every other byte itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, ALLOW = "block", "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs advanced together; bounds the state kept per step.
_LANES = 8192


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, ...]:
        return f"{self.name}**", f"*.{self.name}**"


#: Verdict of a URL that no rule fits: block if one of these globs matches, else allow.
DEFAULT_GLOBS = ("*casino*", "*casino*/**", "*adult-*", "*adult-*/**", "*ads-track*", "*ads-track*/**")


class ShiftAnd:
    """Multiword Shift-And masks of a list of globs, matched against whole strings."""

    def __init__(self, globs: list[str]):
        places: list[tuple[int, int]] = []  # per bit: the byte it waits for (-1: a run's end), and 0 / 1 / 2 for none / * / ** looping on it
        first, last = [], []
        for g in globs:
            raw, loop = g.encode(), 0
            first.append(len(places))
            i = 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    wide = raw[i : i + 2] == b"**"
                    loop, i = max(loop, 1 + wide), i + 1 + wide
                else:
                    places.append((raw[i], loop))
                    loop, i = 0, i + 1
            places.append((-1, loop))  # the accepting place: all bytes read
            last.append(len(places) - 1)
        self.n, self.bits = len(globs), len(places)
        self.words = max(1, -(-self.bits // 64))
        self.byte = np.zeros((256, self.words), np.uint64)  # places that this byte advances
        self.stay = np.zeros((256, self.words), np.uint64)  # places that keep waiting on this byte
        self.start = np.zeros(self.words, np.uint64)
        self.last = last

        def put(mask: np.ndarray, bit: int) -> None:
            mask[bit // 64] |= np.uint64(1 << bit % 64)

        for bit, (c, loop) in enumerate(places):
            if c >= 0:
                put(self.byte[c], bit)
            if loop:
                for b in range(256):
                    if loop == 2 or b != ord("/"):
                        put(self.stay[b], bit)
        for bit in first:
            put(self.start, bit)

    def match(self, strings: list[bytes]) -> np.ndarray:
        """Boolean matrix: row i, column j if glob j matches string i."""
        out = np.zeros((len(strings), self.n), bool)
        lengths = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(order), _LANES):
            lane = order[lo : lo + _LANES]
            n = lengths[lane]
            flat = np.frombuffer(b"".join(strings[i] for i in lane), np.uint8)
            begin = np.cumsum(n) - n
            state = np.tile(self.start, (len(lane), 1))
            live = len(lane)
            for at in range(int(n[0]) if len(n) else 0):
                while live and n[live - 1] <= at:
                    live -= 1
                c = flat[begin[:live] + at]
                s = state[:live]
                moved = s & self.byte[c]
                carry = moved >> np.uint64(63)
                moved <<= np.uint64(1)
                moved[:, 1:] |= carry[:, :-1]
                state[:live] = moved | (s & self.stay[c])
            for j, bit in enumerate(self.last):
                out[lane, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def host_column(url: Column) -> Column:
    """Lower-cased host: after the first ``://`` up to a slash, question mark, number sign or the end."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_column(url: Column) -> Column:
    """What follows the host up to a question mark, a number sign or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[HostRule], globs: tuple[str, ...] = DEFAULT_GLOBS, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Give every row a host, path, rule and verdict.

    Null urls and those without ``://`` have an empty host and path and fit no rule. Repeated rows
    each get a row; no row is dropped. Of rules that fit, the longest wins; a tie goes to the one
    listed first.
    """
    compiled, owner = [], []
    for k, rule in enumerate(rules):
        for g in rule.globs():
            compiled.append(g)
            owner.append(k)
    compiled += globs
    machine = ShiftAnd(compiled)
    by_length = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name.encode()), k))
    slim = pages.select(*keep, host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path"))
    schema = T.StructType([*slim.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            hit = machine.match([(h + p).encode() for h, p in zip(hosts, paths, strict=True)])
            names = np.full(len(hosts), None, object)
            verdicts = np.where(hit[:, len(owner) :].any(axis=1), BLOCK, ALLOW).astype(object)
            undecided = np.ones(len(hosts), bool)
            for k in by_length:
                fits = undecided & hit[:, [j for j, o in enumerate(owner) if o == k]].any(axis=1)
                names[fits], verdicts[fits] = rules[k].name, rules[k].verdict
                undecided &= ~fits
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], schema.names)

    return slim.mapInArrow(run, schema)
