"""Fill-in-the-middle: documents cut in three, with the middle moved to the end.

One fullmatch of (unit)* over a text keeps every repetition of the group. The ends of its captures are
the ends of all units, so their number and both cuts are looked up without going through the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a word with the blanks before it, or blanks at the end of the text
UNITS = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)*"
_UNITS = regex.compile(UNITS)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: str, doc_id) -> list[int]:
    """Four numbers below 2^32 that depend on the seed and the doc_id only; no doc_id is an empty one."""
    own = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{own}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(text: str, numbers: list[int], fim_percent: int, spm_percent: int):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = _UNITS.fullmatch(text).ends(1)
    n = len(ends)
    first, second, form, order = numbers
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or form % 100 >= fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    cut, end = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    if order % 100 < spm_percent:
        return n, "spm", cut, end - cut, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", cut, end - cut, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: str = "42", fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n, form, prefix_chars, middle_chars, output.

    `docs` has doc_id and text; other columns don't matter. A null text is empty; empty texts and texts
    with a mark in them stay plain, as do those that the draw leaves so. The draw goes by doc_id: rows
    that share one are drawn alike, rows without one as if their id were written with no digits. Cuts
    are at ends of units, 0 and n included, so each part can be empty. No rows give no rows.
    A document is one row, cut by one task; nothing is shuffled.
    """

    @F.pandas_udf(PARTS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [
                transform(text, draws(seed, None if own == "" else own), fim_percent, spm_percent)
                for own, text in zip(ids, texts)
            ]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    done = docs.select("doc_id", cut(own, F.coalesce("text", F.lit(""))).alias("parts"))
    return done.select("doc_id", "parts.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    A text with a mark is plain, and no mark can begin in one part and end in the next, as marks begin
    with the only < they have; so the marks of an output are those put there.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
