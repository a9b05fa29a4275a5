"""Musical keys on the wheel of twelve hours, in the two flavours that ordering and metrics use.

They differ on purpose: ordering counts an unknown key as half compatible, metrics as not at all, and
each reads its own spellings.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semitones of key names, and the wheel's hour of each semitone.
SEMITONES = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11}
MINOR_HOURS = (5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10)
MAJOR_HOURS = (8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1)
# The ring order that metrics use, minor keys first, and further spellings.
RING = ("Am", "Em", "Bm", "F#m", "C#m", "G#m", "D#m", "A#m", "Fm", "Cm", "Gm", "Dm", "C", "G", "D", "A", "E", "B", "F#", "C#", "Ab", "Eb", "Bb", "F")
SPELLINGS = {"Abm": "G#m", "Ebm": "D#m", "Bbm": "A#m", "Db": "C#", "Gb": "F#", "Cb": "B"}

RING_PLACES = {k: i for i, k in enumerate(RING)} | {a: RING.index(k) for a, k in SPELLINGS.items()} | {f"{i % 12 + 1}{'AB'[i // 12]}": i for i in range(24)}
MINOR_NAMES = {k: f"{MINOR_HOURS[s]}A" for k, s in SEMITONES.items()}
MAJOR_NAMES = {k: f"{MAJOR_HOURS[s]}B" for k, s in SEMITONES.items()}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def camelot(key: Column | str) -> Column:
    """Hour and ring of a key: "C minor", "Cm", "C" or already "5A"; "?" for anything else.

    A name is read in this order: an hour with A or B is taken as it is, then "<name> minor|major",
    then a short form where a closing m (but not "am") means minor.
    """
    s = F.trim(F.col(key) if isinstance(key, str) else key)
    long_name, scale = F.trim(F.regexp_extract(s, r"^(.*) (\S*)$", 1)), F.lower(F.regexp_extract(s, r"^(.*) (\S*)$", 2))
    short = F.regexp_replace(s, r"[mM]+$", "")
    minor = (s.endswith("m") & ~s.endswith("am")) | F.lower(s).endswith("min")
    as_long = F.when(scale == "minor", _lookup(MINOR_NAMES, long_name)).when(scale == "major", _lookup(MAJOR_NAMES, long_name))
    as_short = F.when(minor, _lookup(MINOR_NAMES, short)).otherwise(_lookup(MAJOR_NAMES, short))
    unknown = s.isNull() | s.isin("", "?", "nan")
    return F.when(unknown, F.lit("?")).when(s.rlike(r"^[0-9]{1,2}[AB]$"), s).otherwise(F.coalesce(as_long, as_short, F.lit("?")))


def _round_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 12 - d)


def ordering_compatibility(a: Column | str, b: Column | str) -> Column:
    """1 for the same hour, one half for neighbours or an unknown key, else 0. Takes ``camelot`` values."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = (F.expr("int(null)") if c is None else F.regexp_extract(c, r"^([0-9]+).$", 1).try_cast("int") for c in (a, b))
    return F.when(x.isNull() | y.isNull(), 0.5).when(x == y, 1.0).when(_round_distance(x, y) == 1, 0.5).otherwise(0.0)


def metrics_compatibility(a: Column | str, b: Column | str) -> Column:
    """1 for the same place of either ring, one half for neighbours, else 0; 0 for an unknown key."""
    x, y = (_lookup(RING_PLACES, F.trim(F.col(c) if isinstance(c, str) else c)) for c in (a, b))
    d = _round_distance(x % 12, y % 12)
    return F.when(x.isNull() | y.isNull(), 0.0).when(d == 0, 1.0).when(d == 1, 0.5).otherwise(0.0)
