"""Words of a text and the text between them, as array expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

WORD = r"[\p{L}\p{N}]+"
BLOCK = 32


def words(text: Column) -> Column:
    """Lowercased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pieces(text: Column) -> Column:
    """The lowercased text cut into gap, word, gap, word, ...: words have odd positions and
    the pieces joined give the text back. One pass over the text."""
    cut = F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    starts_with_word = lambda c: F.coalesce(F.get(c, F.lit(0)).rlike(rf"^{WORD}"), F.lit(False))
    return let(cut, lambda c: F.when(starts_with_word(c), F.concat(F.array(F.lit("")), c)).otherwise(c))


def block_starts(cut: Column) -> Column:
    """Characters before every block of BLOCK pieces. With it the start of any piece costs
    one short join, so a long text is not scanned again per match."""
    sizes = F.transform(F.sequence(F.lit(0), F.floor(F.size(cut) / BLOCK).cast("int")),
                        lambda b: F.length(F.array_join(F.slice(cut, b * BLOCK + 1, F.lit(BLOCK)), "")))
    return F.get(F.transform(F.array(sizes), lambda s: F.transform(
        s, lambda _x, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda acc, x: acc + x))), F.lit(0))


def piece_start(cut: Column, starts: Column, k: Column) -> Column:
    """Characters before piece ``k``."""
    b = F.floor(k / BLOCK).cast("int")
    return F.get(starts, b) + F.length(F.array_join(F.slice(cut, b * BLOCK + 1, k % BLOCK), ""))
