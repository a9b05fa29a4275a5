"""Scalar functions over names and paths, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a directory name must not hold.
UNSAFE = r'[\\/:*?"<>|]'
MAX_DIRNAME = 50


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(name: Column | str) -> Column:
    """File name without its last extension; a name that only starts with a dot keeps it."""
    base = F.regexp_extract(_c(name), r"([^/]*)/*$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)


def extension(name: Column | str) -> Column:
    return F.regexp_extract(_c(name), r"^.*[^/](\.[^./]+)$", 1)


def artist(name: Column | str) -> Column:
    """What stands before the first " - " of the stem; empty where there is none."""
    s = stem(name)
    return F.when(F.instr(s, " - ") > 0, F.trim(F.substring_index(s, " - ", 1))).otherwise(F.lit(""))


def title(name: Column | str) -> Column:
    """What stands after the first " - " of the stem; the whole stem where there is none."""
    s = stem(name)
    return F.when(F.instr(s, " - ") > 0, F.trim(s.substr(F.instr(s, " - ") + 3, F.length(s)))).otherwise(s)


def normalized_filename(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(stem(name))), r"\s+", " ")


def simple_genre(genre: Column | str, empty: str = "") -> Column:
    """What follows the first "---" of a genre; ``empty`` for none."""
    g = _c(genre)
    after = g.substr(F.instr(g, "---") + 3, F.length(g))
    return F.when(F.coalesce(g, F.lit("")) == "", F.lit(empty)).when(F.instr(g, "---") > 0, F.trim(after)).otherwise(g)


def letters(label: Column | str) -> Column:
    """0 is A, 25 Z, 26 AA ...: bijective base 26, up to three letters; negative is Noise."""
    n = _c(label).cast("long")

    def letter(x: Column) -> Column:
        return F.chr(F.lit(65) + x)

    one = letter(n)
    two = F.concat(letter(F.floor(n / 26) - 1), letter(n % 26))
    m = n - 702
    three = F.concat(letter(F.floor(m / 676)), letter(F.floor(m / 26) % 26), letter(m % 26))
    return F.when(n < 0, F.lit("Noise")).when(n < 26, one).when(n < 702, two).otherwise(three)


def letter_label(name: Column | str) -> Column:
    """The label that a letter stands for; Noise is -1."""
    return F.when(_c(name) == "Noise", F.lit(-1)).otherwise(F.ascii(F.upper(_c(name))) - 65)


def subcluster_label(letter: Column | str, label: Column | str) -> Column:
    return F.concat(_c(letter), (_c(label) + 1).cast("string"))


def safe_dirname(name: Column | str) -> Column:
    return F.substring(F.trim(F.regexp_replace(_c(name), UNSAFE, "_")), 1, MAX_DIRNAME)


def track_label(artist_: Column | str, title_: Column | str, filename: Column | str) -> Column:
    """Artist and title where both are filled, else the file's stem."""
    a, t = _c(artist_), _c(title_)
    filled = (F.trim(F.coalesce(a, F.lit(""))) != "") & (F.trim(F.coalesce(t, F.lit(""))) != "")
    return F.when(filled, F.concat(a, F.lit(" - "), t)).otherwise(stem(F.coalesce(_c(filename), F.lit("Unknown"))))


def windows_path(folder: str, filename: Column | str) -> Column:
    return F.concat(F.lit(folder.rstrip("/\\") + "\\"), _c(filename))


def clock(seconds: Column | str) -> Column:
    """Duration as m:ss."""
    s = F.floor(_c(seconds)).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def base_genre(folder: Column | str) -> Column:
    return F.split(_c(folder), r"_\[")[0]


def without_audio_extension(name: Column | str) -> Column:
    """Audio extensions are taken out wherever they stand."""
    out = _c(name)
    for x in (".mp3", ".wav", ".flac"):
        out = F.replace(out, F.lit(x), F.lit(""))
    return out


def cluster_name(label: Column | str) -> Column:
    """Noise, or the label with two digits at least."""
    n = _c(label).cast("string")
    return F.when(_c(label) == -1, F.lit("Noise")).otherwise(F.concat(F.lit("Cluster_"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))


def cluster_order(label: str) -> list[Column]:
    """Sort keys: numbers by value, then other names, noise last."""
    c = F.col(label)
    noise, number = c.isin("-1", "Noise"), c.try_cast("int").isNotNull()
    return [F.when(noise, 2).when(number, 0).otherwise(1), F.when(~noise & number, F.lpad(c, 6, "0")).otherwise(c)]
