"""Text kernel: cleaning, keys, tokens, stems. Everything is a Column function; only texts that need Python are sent to it."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Named entities that cleaning decodes, case-insensitively.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "le": "\u2264", "ge": "\u2265", "times": "\u00d7", "minus": "\u2212", "amp": "&"}
# Tags that count as presentation and become a space.
TAGS = "p|div|span|br|pre|code|strong|b|em|i|ul|ol|li|sub|sup|h[1-6]|table|tr|td|th|a"
# Words that search ignores.
SEARCH_STOP = "a an the and or of to in is are be for with given find return output input problem you your that this each from as on by it".split()
# Retrieval synonyms.
SYNONYMS = {
    "palindromic": "palindrome", "spirally": "spiral", "traversing": "traversal", "scrambled": "scramble", "interleaving": "interleave", "interleaved": "interleave", "loop": "cycle", "cyclic": "cycle", "detect": "check", "detection": "check",
    "checking": "check", "determine": "check", "largest": "maximum", "smallest": "minimum", "max": "maximum", "min": "minimum", "neighbouring": "adjacent", "neighboring": "adjacent", "consecutive": "contiguous", "duplicate": "repeat",
    "repeating": "repeat", "repeated": "repeat", "remove": "delete", "removal": "delete",
}
# Words of judge boilerplate that statements' retrieval tokens leave out.
BOILERPLATE = "integer integers task test case cases format example examples sample print printed line lines space separated denoting denotes function implement already care taken first second third following contains containing consists consist length size array arr nums str string input output note need given return find".split()
# Words that the page matcher ignores.
MATCH_STOP = (
    "a an and are as at be by for from he i in is it its of on or that the their them these they this to was were will with would about above after again against all also am any because been before being below between both but can could did do does doing down during "
    "each few further had has have her hers herself him himself his how into itself just more most much must my myself nor not now off once only other our ours ourselves out own same she should so some such than then there therefore those through under until up very what when where which "
    "while who whom why you your yours yourself yourselves given input output print return find found take taken using use write written implement function method complete task called call example sample expected follow following follows assume contain means mean end ends equal equals greater less "
    "total note first last every eachother asked specified"
).split()
# The stemmer's suffixes and what replaces them, in the order they are tried.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "al", "er", "ic", "ant", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_ENTITY = re.compile(r"&(#x[\da-f]+|#\d+|[a-z]+);", re.I | re.A)


def _decoded(m: re.Match) -> str:
    name = m[1].lower()
    if name[0] != "#":
        return ENTITIES.get(name, m[0])
    n = int(name[2:], 16) if name[1] == "x" else int(name[1:])
    return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]


def _decode_all(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _ENTITY.sub(_decoded, t))


def _compose_all(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _entities(text: Column) -> Column:
    return pandas_udf(_decode_all, "string")(text)


def _nfkc(text: Column) -> Column:
    return pandas_udf(_compose_all, "string")(text)


def _ranges(points: list[int]) -> str:
    """The inside of a character class."""
    edges = [(p, p) for p in points]
    merged = edges[:1]
    for a, b in edges[1:]:
        merged[-1:] = [(merged[-1][0], b)] if a == merged[-1][1] + 1 else [merged[-1], (a, b)]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in merged)


_SETTLED = _ranges([p for p in (*range(0x300), *range(0x2010, 0x2028)) if unicodedata.normalize("NFKC", chr(p)) == chr(p)])
#: Any character but the Latin ones and the common punctuation that composition leaves as they are. Without combining marks, which are not among these, nothing composes.
#: One range is asked for first, so that most characters are not held against all the others.
UNSETTLED = rf"[[^\x{{0}}-\x{{9F}}]&&[^{_SETTLED}]]"


def nfkc(text: Column) -> Column:
    """Compatibility composition. A UDF in a branch is computed for all rows, so it is given a null for every text that is settled already: of those only a null crosses to Python."""
    needed = text.rlike(UNSETTLED)
    return F.coalesce(_nfkc(F.when(needed, text)), text)


def decoded(text: Column) -> Column:
    """Entities decoded once. Numeric ones are decoded in Python, which is sent only the texts that have some; the others in the JVM."""
    plain = text
    for name, char in ENTITIES.items():  # amp comes last: what it yields is not decoded again
        plain = F.regexp_replace(plain, f"(?i)&{name};", char)
    numeric = text.contains("&#")
    return F.coalesce(_entities(F.when(numeric, text)), F.when(text.contains("&"), plain).otherwise(text))


def squeeze(text: Column) -> Column:
    """White space of any kind becomes single spaces, none at the ends. Single spaces stay without being replaced, as nearly all are."""
    return F.trim(F.regexp_replace(text, r"(?U) [\s\uFEFF]+|[\s\uFEFF&&[^ ]][\s\uFEFF]*", " "))


def clean_text(value: Column, compose: bool = True) -> Column:
    """Statement text without markup: script and style go, sup and sub become ^() and _(), listed tags a space; entities are decoded once. compose=False leaves out NFKC."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    bare = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    bare = F.regexp_replace(bare, r"(?is)<sup\b[^>]*>(.*?)</sup>", "^($1)")
    bare = F.regexp_replace(bare, r"(?is)<sub\b[^>]*>(.*?)</sub>", "_($1)")
    bare = F.regexp_replace(bare, rf"(?i)</?(?:{TAGS})\b[^>]*>", " ")
    text = F.when(text.contains("<"), bare).otherwise(text)
    text = decoded(text)
    return squeeze(nfkc(text) if compose else text)


def text_key(value: Column, compose: bool = True) -> Column:
    return F.lower(clean_text(value, compose))


def title_key(title: Column, platform: Column, compose: bool = True) -> Column:
    """The comparable form of a title; a contest letter before it goes only for codeforces."""
    key = text_key(title, compose)
    key = F.when(platform == "codeforces", F.regexp_replace(key, r"^[a-z]\.\s+", "")).otherwise(key)
    key = F.regexp_replace(key, r"(?<![A-Za-z0-9_])(a|an|the)(?![A-Za-z0-9_])", " ")
    return squeeze(F.regexp_replace(key, r"[^\p{L}\p{N}+<>=-]+", " "))


def fingerprint(description: Column, constraints: Column) -> Column:
    """sha256 over both cleaned parts; case counts, presentation white space does not."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(F.coalesce(description, F.lit("")), F.coalesce(constraints, F.lit("")))), 256))


def review_fingerprint(title: Column, statement: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(title, statement)), 256))


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column, compose: bool = False) -> Column:
    """Distinct search tokens in order of first use."""
    text = F.lower(F.coalesce(nfkc(text) if compose else text, F.lit("")))
    return F.array_distinct(F.array_except(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), words(SEARCH_STOP)))


def retrieval_tokens(text: Column, statement: bool) -> Column:
    """Tokens for candidate retrieval: plural s and synonyms folded, digits and short tokens dropped; statements also lose boilerplate."""
    found = tokens(F.regexp_replace(text, r"(?i)([234])(?<![A-Za-z0-9_][234])sum(?![A-Za-z0-9_])", "$1 sum"))
    if not statement:
        found = F.transform(found, lambda t: F.when(t == "2", "two").when(t == "3", "three").when(t == "4", "four").otherwise(t))
    found = F.transform(found, lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.rlike("(ss|us|is)$"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    names = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    found = F.transform(found, lambda t: F.when(t.isin(list(SYNONYMS)), F.element_at(names, t)).otherwise(t))  # the map alone would be searched word by word
    found = F.filter(found, lambda t: ~t.rlike("^[0-9]+$") & (F.length(t) >= 2))
    return F.array_distinct(F.array_except(found, words(BOILERPLATE)) if statement else found)


def measure(stem: Column) -> Column:
    return F.regexp_count(stem, F.lit("[aeiou][^aeiou]"))


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))


def _closed(stem: Column) -> Column:
    return stem.rlike("[^aeiou][aeiou][^aeiouwxy]$")


def _after_b(stem: Column) -> Column:
    return (
        F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike(r"([^aeioulsz])\1$"), _cut(stem, 1)).when((measure(stem) == 1) & _closed(stem), F.concat(stem, F.lit("e"))).otherwise(stem)
    )


def stemmed(found: Column) -> Column:
    """Stems of an array of lower-case words. One transform a step, so that no step repeats the ones before it; words of two letters stay."""
    marked = F.transform(found, lambda w: F.struct(w.alias("w"), (F.length(w) > 2).alias("long")))

    def each(rows: Column, step) -> Column:
        return F.transform(rows, lambda r: F.struct(F.when(r["long"], step(r["w"])).otherwise(r["w"]).alias("w"), r["long"].alias("long")))

    marked = each(marked, lambda w: F.when(w.rlike("(sses|ies)$"), _cut(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, 1)).otherwise(w))
    vowel = "[aeiou]"
    marked = each(
        marked,
        lambda w: F.when(w.endswith("eed"), F.when(measure(_cut(w, 3)) > 0, _cut(w, 1)).otherwise(w))
        .when(w.endswith("ed"), F.when(_cut(w, 2).rlike(vowel), F.concat(_cut(w, 2), F.lit("|"))).otherwise(w))
        .when(w.endswith("ing"), F.when(_cut(w, 3).rlike(vowel), F.concat(_cut(w, 3), F.lit("|"))).otherwise(w))
        .otherwise(w),
    )
    marked = each(marked, lambda w: F.when(w.endswith("|"), _after_b(_cut(w, 1))).otherwise(w))
    marked = each(marked, lambda w: F.when(w.endswith("y") & _cut(w, 1).rlike(vowel), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))

    def rules(word: Column, table: list[tuple[str, str]], least: int) -> Column:
        out = None
        for suffix, to in table:
            stem = _cut(word, len(suffix))
            hit = word.endswith(suffix) & (measure(stem) > least)
            out = F.when(hit, F.concat(stem, F.lit(to))) if out is None else out.when(hit, F.concat(stem, F.lit(to)))
        return out.otherwise(word)

    marked = each(marked, lambda w: rules(w, STEP_2, 0))
    marked = each(marked, lambda w: rules(w, STEP_3, 0))
    marked = each(marked, lambda w: rules(w, [(s, "") for s in STEP_4], 1))
    marked = each(marked, lambda w: F.when(w.rlike("[st]ion$") & (measure(_cut(w, 3)) > 1), _cut(w, 3)).otherwise(w))
    marked = each(marked, lambda w: F.when(w.endswith("e") & ((measure(_cut(w, 1)) > 1) | ((measure(_cut(w, 1)) == 1) & ~_closed(_cut(w, 1)))), _cut(w, 1)).otherwise(w))
    marked = each(marked, lambda w: F.when((measure(w) > 1) & w.endswith("ll"), _cut(w, 1)).otherwise(w))
    return F.transform(marked, lambda r: r["w"])


_RULES = [(STEP_2, 0), (STEP_3, 0), ([(suffix, "") for suffix in STEP_4], 1)]
_PAIRS, _CLOSED = re.compile("[aeiou][^aeiou]"), re.compile("[^aeiou][aeiou][^aeiouwxy]\\Z")
_VOWEL, _DOUBLE = re.compile("[aeiou]"), re.compile(r"([^aeioulsz])\1\Z")


@functools.lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case ASCII word, as of stemmed(). A worker remembers the words it met, so a text costs little more than looking its words up."""
    if len(word) <= 2:
        return word
    m = lambda w: len(_PAIRS.findall(w))
    w = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1] if word.endswith("s") else word
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif w.endswith("ed") and _VOWEL.search(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and not w.endswith("ed") and _VOWEL.search(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if _DOUBLE.search(cut) else cut + "e" if m(cut) == 1 and _CLOSED.search(cut) else cut
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for table, least in _RULES:
        w = next((w[: -len(suffix)] + to for suffix, to in table if w.endswith(suffix) and m(w[: -len(suffix)]) > least), w)
    if w.endswith(("sion", "tion")) and m(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not _CLOSED.search(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w) > 1 else w


def _match_all(text: pd.Series) -> pd.Series:
    stop = frozenset(MATCH_STOP)
    kept = lambda words: [w for w in dict.fromkeys(words) if len(w) >= 2 and w not in stop]
    return text.map(lambda t: kept(map(stem, kept(w for w in t.split(" ") if not w.isdigit()))))


def match_tokens(text: Column) -> Column:
    """The page matcher's tokens: ASCII words without stop words and numbers, stemmed, distinct, in order."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return pandas_udf(_match_all, "array<string>")(plain)


def bigrams(found: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(found), F.lit(2))), lambda i: F.concat_ws(" ", F.get(found, i - 2), F.get(found, i - 1)))
    return F.when(F.size(found) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def search_normal(value: Column) -> Column:
    """The library's comparable form: lower case, letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))


def retrieval_body(text: Column, units: int = 10_000) -> Column:
    """A statement up to the first input or output heading, and so many characters of it."""
    return F.substring(F.get(F.split(text, r"(?i)(?=[ios])(?<![A-Za-z0-9_])(?:input\s*format|output\s*format|sample\s*input)\s*:", 2), F.lit(0)), 1, units)


def html_text(value: Column) -> Column:
    """Titles of schedule pages: tags go, the common entities are decoded, ends are trimmed."""
    text = F.regexp_replace(value, "<[^>]*>", "")
    text = F.coalesce(_entities(F.when(text.rlike("&#(?!39;)"), text)), text)
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def threshold(value: Column, default: float = 0.4) -> Column:
    """A matching threshold between 0.1 and 1, else the default."""
    number = value.cast("double")
    return F.when(number.between(0.1, 1), number).otherwise(F.lit(default))


def joined_statement(texts: Column, units: int = 12_000) -> Column:
    """Distinct statements (an array) joined in order, up to so many characters: the field that search looks into."""
    return F.substring(F.array_join(F.array_sort(F.array_distinct(texts)), " "), 1, units)


def video_query(title: Column, number: Column, platform: str) -> Column:
    """What to look for a solution's video by: the platform's number where there is one, the title, and 'solution'."""
    return F.concat_ws(" ", F.when(number.isNotNull(), F.concat(F.lit(platform + " "), number.cast("string"))), title, F.lit("solution"))
