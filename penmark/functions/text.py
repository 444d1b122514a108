"""Column expressions over text: cleaning, tokens, sentences, stress, counting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

# Look-behind and possessive quantifiers keep every match linear in the text,
# also on long digit or punctuation runs.
WORD = r"(?<![\p{L}\p{N}])\p{N}*+\p{L}[\p{L}\p{N}]*+"
SENTENCE_END = r"(?<![.!?])[.!?]++\s+|\n+"

# Vowel nuclei of a lowercased Spanish word and its written accents.
NUCLEUS = r"[iuü]?[aeoáéó][iuü]?|[iuü]+|[íú]"
ACCENT = "[áéíóú]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_es(text: Column | str) -> Column:
    """Plain vowels for ä ï ö, a blank after opening marks, then lowercase."""
    t = F.translate(_col(text), "äïö", "aio")
    t = F.replace(t, F.lit("¿"), F.lit("¿ "))
    t = F.replace(t, F.lit("¡"), F.lit("¡ "))
    return F.lower(t)


def utterance_id(sent_id: Column | str) -> Column:
    """The sentence id up to and including its first ``.u<digits>`` part."""
    return F.regexp_extract(_col(sent_id), r"^(.*?\.u[0-9]*)", 1)


def tokens(text: Column | str) -> Column:
    """Lowercased words holding at least one letter; empty for a missing text."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), 0)
    return F.coalesce(found, F.array().cast("array<string>"))


def n_words(text: Column | str) -> Column:
    """Number of whitespace-separated words; null for a missing text."""
    return F.regexp_count(_col(text), F.lit(r"\S+"))


def more_words_than(text: Column | str, n: int) -> Column:
    """True for texts of more than n words; the match ends at word n + 1."""
    return _col(text).rlike(rf"^\s*+(?:\S++\s++){{{n}}}\S")


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty sentences; empty for a missing text."""
    parts = F.transform(F.split(_col(text), SENTENCE_END), lambda s: F.trim(s))
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def all_uppercase(text: Column | str) -> Column:
    """True for a text with an uppercase letter and no lowercase or titlecase one; ``ª`` and ``º`` are lowercase."""
    t = _col(text)
    return t.rlike(r"\p{IsUppercase}") & ~t.rlike(r"[\p{IsLowercase}\p{Lt}]")


def occurrences(text: Column | str, pattern: str) -> Column:
    """Non-overlapping, case-sensitive occurrences of a fixed pattern."""
    t = _col(text)
    gone = F.length(t) - F.length(F.replace(t, F.lit(pattern), F.lit("")))
    return (gone / F.lit(len(pattern))).cast("bigint")


def common_prefix(x: Column | str, y: Column | str) -> Column:
    """Length of the longest common prefix of two strings, in one pass over their characters."""
    same = F.zip_with(F.split(_col(x), ""), F.split(_col(y), ""), lambda a, b: (a == b) & (a != ""))
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _stress_pattern(n: Column, k: Column) -> Column:
    return F.concat(F.repeat(F.lit("-"), k - 1), F.lit("+"), F.repeat(F.lit("-"), n - k))


def stress_words(words: Column | str, unstressed: Iterable[str] = ()) -> Column:
    """Stress patterns of an array of lowercased Spanish words, one sign per syllable.

    A written accent marks the stressed nucleus; otherwise it is the last but one
    after a final vowel, ``n`` or ``s``, else the last. One-syllable function
    words (``unstressed``) carry no stress. The nuclei of a word are counted in a
    step of their own, so that the later steps do not count them again.
    """
    weak = sorted(unstressed)
    counted = F.transform(
        _col(words), lambda w: F.struct(w.alias("w"), F.regexp_count(w, F.lit(NUCLEUS)).alias("n"))
    )

    def position(w: Column, n: Column) -> Column:
        accented = F.regexp_count(F.regexp_extract(w, f"^.*?{ACCENT}", 0), F.lit(NUCLEUS))
        return (
            F.when(w.rlike(ACCENT), accented)
            .when(w.rlike("[aeiouáéíóúüns]$"), F.greatest(n - 1, F.lit(1)))
            .otherwise(n)
        )

    def pattern(s: Column) -> Column:
        w, n = s["w"], s["n"]
        out = F.when(n == 0, F.lit("")).when(n == 1, F.when(w.isin(weak), F.lit("-")).otherwise(F.lit("+")))
        placed = F.transform(F.array(position(w, n)), lambda k: _stress_pattern(n, k))
        return out.otherwise(placed[0])

    return F.transform(counted, pattern)


def stress_text(words: Column | str, unstressed: Iterable[str] = ()) -> Column:
    """Concatenated stress patterns of a token array."""
    return F.array_join(stress_words(words, unstressed), "")


def stress_of(unstressed: Iterable[str] = ()) -> Callable[[str], str]:
    """The rule of ``stress_words`` for one word at a time, for steps that see each distinct word once."""
    weak, nucleus, accent = frozenset(unstressed), re.compile(NUCLEUS), re.compile(ACCENT)
    accented, open_end = re.compile("[^\n\r\u0085\u2028\u2029]*?" + ACCENT), re.compile("[aeiouáéíóúüns]$")

    def pattern(word: str) -> str:
        n = len(nucleus.findall(word))
        if n < 2:
            return "" if n == 0 else "-" if word in weak else "+"
        if accent.search(word):
            found = accented.match(word)
            k = len(nucleus.findall(found.group())) if found else 0
        else:
            k = max(n - 1, 1) if open_end.search(word) else n
        return "-" * (k - 1) + "+" + "-" * (n - k)

    return pattern


def first_name(name: Column | str) -> Column:
    return F.substring_index(_col(name), " ", 1)


def decade(year: Column | str) -> Column:
    """Birth year to decade, half to even."""
    return F.bround(_col(year).cast("int"), -1).cast("int")


def longest_ngrams(units: Column | str, high: int, glue: str) -> Column:
    """For every start in a unit array the n-gram of ``high`` units, shorter at the end.

    Built by zipping with the shifted units, so the work is linear in the text.
    """
    units = _col(units)
    grams = units
    for n in range(2, high + 1):
        shifted = F.slice(units, F.lit(n), F.size(units))
        grams = F.zip_with(grams, shifted, lambda a, b: F.when(b.isNull(), a).otherwise(F.concat(a, F.lit(glue), b)))
    return grams


def gram_prefixes(gram: Column | str, low: int, high: int, glue: str) -> Column:
    """The prefixes of ``low..high`` units of one n-gram; null where it is shorter."""
    gram = _col(gram)
    if glue:
        size = F.length(gram) - F.length(F.replace(gram, F.lit(glue), F.lit(""))) + 1
        prefix = lambda n: F.substring_index(gram, glue, n)
    else:
        size = F.length(gram)
        prefix = lambda n: F.substring(gram, 1, n)
    return F.array(*[F.when(size >= n, prefix(n)) for n in range(low, high + 1)])


def characters(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), ""), lambda c: c != "")
