"""Text expressions: trimming, missing values, title case, phonetic codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as missing when records are compared, and when values are cleaned.
MISSING_COMPARED = ("", "nan", "none", "null")
MISSING_CLEANED = ("", "nan", "None")


def utrim(c: Column) -> Column:
    """Trim all Unicode white space, not spaces alone; a text that begins and ends in visible ASCII needs no pattern."""
    clean = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(clean, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def norm(c: Column) -> Column:
    """Trimmed lower case for comparison; missing values become NULL, so equi-joins drop them."""
    t = F.lower(utrim(c.cast("string")))
    return F.when(~t.isin(*MISSING_COMPARED), t)


def present(c: Column) -> Column:
    """Trimmed value with its case, or NULL if it is missing."""
    t = utrim(c.cast("string"))
    return F.when(~F.lower(t).isin(*MISSING_COMPARED), t)


def cleaned(c: Column, then) -> Column:
    """then(trimmed) for values that are there, "" for missing ones."""
    t = utrim(c.cast("string"))
    return F.when(c.isNull() | t.isin(*MISSING_CLEANED), F.lit("")).otherwise(then(t))


def prefix4(c: Column) -> Column:
    return F.substring(F.lower(c), 1, 4)


def pytitle(c: Column) -> Column:
    """Each run of letters starts upper case and goes on in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def _raise_after(c: Column, prefix: str) -> Column:
    parts = F.split(F.regexp_replace(c, rf"\b{prefix}([a-z])", f"{prefix}\u0001$1"), "\u0001")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))), "")


def title_case(c: Column) -> Column:
    """Title case with O'Brien, McDonald and MacLeod, and possessives in lower case."""
    return cleaned(c, lambda t: _raise_after(_raise_after(F.regexp_replace(pytitle(t), r"'S\b", "'s"), "Mc"), "Mac"))


def metaphone_code(word: str) -> str:
    """Metaphone of a word after the published rules (Philips, 1990)."""
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    if not w:
        return ""
    for start, drop in (("KN", 1), ("GN", 1), ("PN", 1), ("AE", 1), ("WR", 1)):
        if w.startswith(start):
            w = w[drop:]
            break
    if w.startswith("X"):
        w = "S" + w[1:]
    if w.startswith("WH"):
        w = "W" + w[2:]
    out, n = [], len(w)
    vowels, front = "AEIOU", "EIY"
    at = lambda i: w[i] if 0 <= i < n else ""
    for i, c in enumerate(w):
        if c == at(i - 1) and c != "C":
            continue
        nxt, prev = at(i + 1), at(i - 1)
        if c in vowels:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and prev == "M"):
                out.append("B")
        elif c == "C":
            if prev == "S" and nxt and nxt in front:
                continue
            if nxt == "I" and at(i + 2) == "A" or nxt == "H" and prev != "S":
                out.append("X")
            elif nxt and nxt in front:
                out.append("S")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if nxt == "G" and at(i + 2) and at(i + 2) in front else "T")
        elif c == "G":
            if nxt == "H" and not (i + 2 < n and at(i + 2) in vowels) or nxt == "N" and i + 2 >= n:
                continue
            if prev == "D" and nxt and nxt in front:
                continue
            out.append("J" if nxt and nxt in front else "K")
        elif c == "H":
            if prev and prev in "CSPTG" or not (nxt and nxt in vowels):
                continue
            out.append("H")
        elif c == "K":
            if prev != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if nxt == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            out.append("X" if nxt == "H" or nxt == "I" and at(i + 2) and at(i + 2) in "OA" else "S")
        elif c == "T":
            if nxt == "I" and at(i + 2) and at(i + 2) in "OA":
                out.append("X")
            elif nxt == "H":
                out.append("0")
            elif not (nxt == "C" and at(i + 2) == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if nxt and nxt in vowels:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
    return "".join(out)


def metaphone(c: Column) -> Column:
    """Metaphone code, or the first four letters where there is none; NULL stays. Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else metaphone_code(v) or v.lower()[:4])

    return F.pandas_udf(run, "string")(c)


PHONETIC = {"prefix4": prefix4, "metaphone": metaphone, "soundex": F.soundex}
