"""The published suffix-stripping rules (M. F. Porter, 1980), written out plainly to check the engine's stemmer against."""


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


TWO = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
THREE = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _longest(w: str, suffixes: list[str]) -> str | None:
    found = [s for s in suffixes if w.endswith(s)]
    return max(found, key=len) if found else None


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _participle(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
    if cut is None:
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if _double(cut) and cut[-1] not in "lsz":
        return cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _short(cut) else cut


def stem(w: str) -> str:
    """With a plural and participle pass of its own before, as the engine has it. Words of one or two letters stay."""
    if len(w) <= 2:
        return w
    w = _participle(_plural(w))
    if len(w) <= 2:
        return w
    w = _participle(_plural(w))
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (TWO, THREE):
        rules = dict(x.split(":") for x in table.split())
        s = _longest(w, list(rules))
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = _longest(w, FOUR.split())
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
