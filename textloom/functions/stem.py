"""The Porter stemmer as a chain of SQL projections, evaluated by the engine without Python.

Each step is a SQL expression over the step before. The same chain is generated for Spark and for DuckDB, whose
functions for regular expressions differ in name; the patterns use neither look-around nor back references nor backslashes.

Whole texts take the same steps in Python, where a worker keeps the stems of frequent words: there a join with the stemmed
vocabulary would shuffle every word of every text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: At least one, exactly one, and at least two vowel-consonant sequences; a vowel; consonant-vowel-consonant.
M1, M_1, M2 = f"^({_CS})?{_VS}{_CS}", f"^({_CS})?{_VS}{_CS}({_VS})?$", f"^({_CS})?{_VS}{_CS}{_VS}{_CS}"
HAS_VOWEL, CVC = f"^({_CS})?{_V}", f"^{_CS}{_V}[^aeiouwxy]$"
DOUBLE = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + ")$"

# Suffixes and what replaces them in the second and third steps, and suffixes dropped in the fourth.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# End of fixed values.


class Dialect:
    """Names of the two regular expression functions."""

    def __init__(self, matches: str) -> None:
        self.matches = matches

    def like(self, value: str, pattern: str) -> str:
        return f"{self.matches}({value}, '{pattern}')"

    def part(self, value: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({value}, '{pattern}', {group})"


SPARK, DUCKDB = Dialect("regexp_like"), Dialect("regexp_matches")


def _cut(w: str, n: int) -> str:
    return f"substr({w}, 1, length({w}) - {n})"


def _plural(d: Dialect, w: str) -> str:
    return f"case when {d.like(w, '.(ss|i)es$')} then {_cut(w, 2)} when {d.like(w, '.[^s]s$')} then {_cut(w, 1)} else {w} end"


def _participle(d: Dialect, w: str) -> str:
    base = d.part(w, "^(.+?)(ed|ing)$")
    return (
        f"case when {d.like(w, '.eed$')} then case when {d.like(_cut(w, 3), M1)} then {_cut(w, 1)} else {w} end "
        f"when {d.like(w, '.(ed|ing)$')} and {d.like(base, HAS_VOWEL)} then case "
        f"when {d.like(base, '(at|bl|iz)$')} then concat({base}, 'e') when {d.like(base, DOUBLE)} then {_cut(base, 1)} "
        f"when {d.like(base, CVC)} then concat({base}, 'e') else {base} end else {w} end"
    )


def _replace(d: Dialect, w: str, table: dict[str, str]) -> str:
    pattern = f"^(.+?)({'|'.join(table)})$"
    base, suffix = d.part(w, pattern), d.part(w, pattern, 2)
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"case when {d.like(w, pattern)} and {d.like(base, M1)} then concat({base}, case {suffix} {cases} end) else {w} end"


def _fourth(d: Dialect, w: str) -> str:
    pattern = f"^(.+?)({'|'.join(FOURTH)})$"
    return (
        f"case when {d.like(w, pattern)} then case when {d.like(d.part(w, pattern), M2)} then {d.part(w, pattern)} else {w} end "
        f"when {d.like(w, '.(s|t)ion$')} and {d.like(_cut(w, 3), M2)} then {_cut(w, 3)} else {w} end"
    )


def _last_e(d: Dialect, w: str) -> str:
    base = _cut(w, 1)
    return f"case when {d.like(w, '.e$')} and ({d.like(base, M2)} or ({d.like(base, M_1)} and not {d.like(base, CVC)})) then {base} else {w} end"


def _last_l(d: Dialect, w: str) -> str:
    return f"case when {d.like(w, 'll$')} and {d.like(w, M2)} then {_cut(w, 1)} else {w} end"


def _last_y(d: Dialect, w: str) -> str:
    return f"case when {d.like(w, '.y$')} and {d.like(_cut(w, 1), HAS_VOWEL)} then concat({_cut(w, 1)}, 'i') else {w} end"


def steps(d: Dialect, word: str) -> list[str]:
    """Expressions over ``word``, each to be applied to the result of the one before.

    Words of one or two letters stay. The plural and participle steps run twice: once as a pass of their own, then as part of the stemmer.
    A leading y counts as a consonant throughout.
    """
    guard = lambda e: f"case when length({word}) > 2 then {e} else {word} end"
    marked = f"case when substr({word}, 1, 1) = 'y' then concat('Y', substr({word}, 2)) else {word} end"
    chain = [_plural, _participle, _plural, _participle, _last_y, lambda d, w: _replace(d, w, SECOND), lambda d, w: _replace(d, w, THIRD), _fourth, _last_e, _last_l]
    return [marked, *[guard(f(d, word)) for f in chain], f"lower({word})"]


def stem_words(words: DataFrame, column: str = "term", into: str = "stem") -> DataFrame:
    """Adds the stem of a column of lower-case words. Each step binds the one before to a variable, so the expression grows with the number of steps only."""
    value = f"`{column}`"
    for e in steps(SPARK, "w"):
        value = f"transform(array({value}), w -> {e})[0]"
    return words.withColumn(into, F.expr(value))


def stem_sql(source: str, column: str = "term", into: str = "stem") -> str:
    """The same as a DuckDB subquery over ``source``."""
    sql = f"(select *, {column} as {into} from {source})"
    for e in steps(DUCKDB, into):
        sql = f"(select * replace (({e}) as {into}) from {sql})"
    return sql


#: Stems that a Python worker keeps, and texts that it gets at once.
KEPT, TEXT_ROWS = 1 << 18, 1024


@lru_cache(None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _like(w: str, pattern: str) -> bool:
    return _compiled(pattern).search(w) is not None


def _replaced(w: str, table: dict[str, str], ends: tuple[str, ...]) -> str:
    if not w.endswith(ends):
        return w
    found = _compiled(f"^(.+?)({'|'.join(table)})$").search(w)
    return found[1] + table[found[2]] if found and _like(found[1], M1) else w


def _unplural(w: str) -> str:
    if not w.endswith("s"):
        return w
    return w[:-2] if _like(w, ".(ss|i)es$") else w[:-1] if _like(w, ".[^s]s$") else w


def _unparticiple(w: str) -> str:
    if not w.endswith(("ed", "ing")):
        return w
    if _like(w, ".eed$"):
        return w[:-1] if _like(w[:-3], M1) else w
    found = _compiled("^(.+?)(ed|ing)$").search(w)
    if not found or not _like(base := found[1], HAS_VOWEL):
        return w
    if _like(base, "(at|bl|iz)$"):
        return base + "e"
    if _like(base, DOUBLE):
        return base[:-1]
    return base + "e" if _like(base, CVC) else base


_SECOND, _THIRD = tuple(SECOND), tuple(THIRD)


@lru_cache(KEPT)
def stem_word(word: str) -> str:
    """The stem of one lower-case word by the steps of ``steps``; a word's end says which of them need a look."""
    if len(word) <= 2:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    w = _unparticiple(_unplural(_unparticiple(_unplural(w))))
    if w.endswith("y") and len(w) > 1 and _like(w[:-1], HAS_VOWEL):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, SECOND, _SECOND), THIRD, _THIRD)
    if w.endswith(FOURTH) and (found := _compiled(f"^(.+?)({'|'.join(FOURTH)})$").search(w)):
        w = found[1] if _like(found[1], M2) else w
    elif w.endswith("ion") and _like(w, ".(s|t)ion$") and _like(w[:-3], M2):
        w = w[:-3]
    if w.endswith("e") and len(w) > 1 and (_like(w[:-1], M2) or (_like(w[:-1], M_1) and not _like(w[:-1], CVC))):
        w = w[:-1]
    return (w[:-1] if w.endswith("ll") and _like(w, M2) else w).lower()


def stem_lists(spark: SparkSession, words: Column | str) -> Column:
    """A list of lower-case words of each row -> their stems, in order."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))

    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        values = pa.array([stem_word(w) for w in coded.dictionary.to_pylist()], pa.string())
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), values.take(coded.indices))

    return stems(words)
