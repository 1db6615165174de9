"""Text analysis as column expressions: normalisation steps, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the normalised form. Each match becomes one space, in this order.
NON_ASCII = r"[^\x00-\x7F]"
CHARSET = r"[^a-zA-Z0-9/?:().,'+-]"
CONTROL = r"\p{C}"
URL = r"(?:https?|ftp|gopher|telnet|file|Unsure):(?://|\\)+[\w:#@%/;$()~?+-=\\.&]*"
PUNCTUATION = r"\p{Punct}"
DIGIT = r"\d"
SINGLE = r"\s+.(?=\s)"
BLANKS = r"\s+"
# End of fixed values.

STEPS = {
    "ascii": NON_ASCII, "charset": CHARSET, "control": CONTROL, "url": URL, "punctuation": PUNCTUATION, "digits": DIGIT, "singles": SINGLE, "blanks": BLANKS,
}


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def step(text: Column | str, name: str) -> Column:
    """One step on its own."""
    return F.regexp_replace(_column(text), F.lit(STEPS[name]), F.lit(" "))


def steps_upto(text: Column | str, last: str) -> Column:
    """All steps up to and with ``last``."""
    out = _column(text)
    for name in STEPS:
        out = step(out, name)
        if name == last:
            return out
    raise ValueError(f"no step {last!r}; there are {', '.join(STEPS)}")


def normalize(text: Column | str) -> Column:
    """The normalised form; a null text stays null. Not trimmed."""
    return F.lower(steps_upto(text, "blanks"))


#: What lies between two tokens: anything but letters, and single letters that stand between such.
_BETWEEN = r"[^a-zA-Z]+(?:[a-zA-Z][^a-zA-Z]+)*+"


def tokens(text: Column | str) -> Column:
    """Tokens of the normalised form, in order, repeats kept; none for a null text.

    All steps but the URLs only turn characters into spaces, and a token is a run of letters; so one pass finds what the steps leave.
    Texts that may hold a URL take the steps up to it first.
    """
    text = _column(text)
    plain = F.when(F.contains(text, F.lit("://")), step(step(text, "charset"), "url")).otherwise(text)
    words = F.trim(F.lower(F.regexp_replace(plain, F.lit(_BETWEEN), F.lit(" "))))
    return F.when(F.length(words) > 0, F.split(words, " ")).otherwise(_empty())


def _once(value: Column, use) -> Column:
    """The array ``use(value)`` makes, with ``value`` evaluated once, not at each place where ``use`` refers to it."""
    return F.flatten(F.transform(F.array(value), use))


def _empty() -> Column:
    return F.array().cast("array<string>")


def counted(words: Column | str) -> Column:
    """Each distinct word of a list and how often it occurs: array of (term, tf), by runs of the sorted list."""

    def runs(w: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i > 0) & F.coalesce(F.get(w, i - 1) != F.get(w, i), F.lit(True)))
        return _once(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(w, i - 1).alias("term"), (i - F.when(k > 0, F.get(e, k - 1)).otherwise(0)).alias("tf"))))

    return _once(F.sort_array(_column(words)), runs)


def word_ngrams(words: Column | str, n: int) -> Column:
    """n neighbouring words joined by a space; none where there are fewer."""

    def grams(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(_empty())

    return _once(_column(words), grams)


def char_ngrams(text: Column | str, n: int) -> Column:
    """Substrings of n characters; none where there are fewer."""

    def grams(t: Column) -> Column:
        return F.when(F.char_length(t) >= n, F.transform(F.sequence(F.lit(1), F.char_length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(_empty())

    return _once(_column(text), grams)
