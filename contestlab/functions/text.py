"""Names and search text; ASCII folding by a fixed table of accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžćčđ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszccd"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def fold(text: Column) -> Column:
    """Lower case without accents, blanks merged."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\s+", " "))


def name_key(name: Column) -> Column:
    """Folded words without punctuation, hyphens as blanks, generational suffixes dropped."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(fold(name), r"[-#]", " "), r"[^a-z0-9 ]", "")), r" +")
    kept = F.filter(words, lambda w, i: (i == 0) | ~w.isin(*SUFFIXES))
    return F.array_join(kept, " ")


def first_last(name: Column) -> Column:
    """'Last, First' as 'First Last'; anything else as it is."""
    return F.when(F.instr(name, ",") > 0, F.concat(F.trim(F.split_part(name, F.lit(","), F.lit(2))), F.lit(" "), F.trim(F.split_part(name, F.lit(","), F.lit(1))))).otherwise(name)


def match_tier(text: Column, query: Column) -> Column:
    """How well folded text answers a folded query: 0 equal, 1 prefix, 2 prefix of a word, 3 inside (two letters and
    more), 4 all words somewhere, null for no match."""
    every = F.forall(F.split(query, " "), lambda w: F.instr(text, w) > 0)
    return (
        F.when(text == query, 0)
        .when(text.startswith(query), 1)
        .when(F.instr(text, F.concat(F.lit(" "), query)) > 0, 2)
        .when((F.length(query) >= 2) & (F.instr(text, query) > 0), 3)
        .when((F.size(F.split(query, " ")) > 1) & every, 4)
    )
