"""Column functions over texts: folding, cutting, counting and rewriting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: By Unicode's own decomposition, Korean syllables aside: characters that fold to one other, to none, and to several.
_FOLDING = {c: f for c in map(chr, (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000))) if (f := _folded(c)) != c}
_FROM = "".join(sorted(_FOLDING, key=lambda c: (len(_FOLDING[c]) != 1, c)))
_TO = "".join(_FOLDING[c] for c in _FROM if len(_FOLDING[c]) == 1)  # the others have no counterpart, and go
_SEVERAL = {c: f for c, f in _FOLDING.items() if len(f) > 1}
#: Titles before a person's name, and what counts as a number of its own.
TITLE = r"(?i)^(mr|mrs|ms|miss|dr|prof|sir|m|mme|mlle)\b\.?"
NUMBER = r"(?<![\w.])\d+(?:[.,]\d+)?(?![\w.])"
#: Words, some with their trailing blank, that call for grouping, ordering or arithmetic.
HARD_WORDS = ("per ", "each ", "average", "rate", "ratio", "percentage", "proportion", "most", "least", "top", "compare", "between", "trend", "median")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normalize(text: Column) -> Column:
    """Lower case, compatibility forms written out, accents dropped: spellings that differ in these alone fold alike, in any script.

    Korean syllables stay whole, which tells them apart as well as their letters would. Characters that fold to several are
    rare: only a text that holds one is taken apart.
    """
    known = F.str_to_map(F.lit("\x02".join(f"{c}\x01{f}" for c, f in _SEVERAL.items())), F.lit("\x02"), F.lit("\x01"))

    def whole(low: Column) -> Column:
        rare = F.translate(low, "".join(_SEVERAL), "") != low
        written = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
        return F.translate(F.when(rare, written).otherwise(low), _FROM, _TO)

    return F.get(F.transform(F.array(F.lower(text)), whole), F.lit(0))


def tokens(text: Column) -> Column:
    return find_all(normalize(text), "[a-z0-9&]+")


def parts(value: Column) -> Column:
    """The value and, if it is long and has several, its first six segments of more than three characters."""
    cut = F.filter(F.split(value, r"\s*[|/;:]\s*"), lambda p: F.length(F.trim(p)) > 3)
    return F.when((F.length(value) > 32) & (F.size(cut) > 1), F.concat(F.array(value), F.slice(cut, 1, 6))).otherwise(F.array(value))


def trigrams(text: Column) -> Column:
    """The three-character pieces of the text's words, padded with two blanks on either side, with repetitions."""
    padded = F.concat(F.lit("  "), F.array_join(find_all(F.lower(text), "[a-z0-9]+"), " "), F.lit("  "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))


def counted(items: Column) -> Column:
    """array<struct<item, n>>: the distinct items of an array and how often each stands there, in their order."""

    def runs(items: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | ~F.get(items, i).eqNullSafe(F.get(items, i - 1)))
        end = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(items))
        return F.get(F.transform(F.array(starts), lambda s: F.transform(s, lambda i, j: F.struct(F.get(items, i).alias("item"), (end(s, j) - i).cast("long").alias("n")))), F.lit(0))

    # What is sorted is worked out once.
    return F.get(F.transform(F.array(F.sort_array(items)), lambda s: F.when(F.size(s) > 0, runs(s))), F.lit(0))


def preview(text: Column, most: int = 90) -> Column:
    """The beginning of the text in one line."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def numbers(text: Column) -> Column:
    return find_all(text, NUMBER)


def as_number(text: Column) -> Column:
    """The number that a text states, with a comma or a point; null if none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def replace_first(text: Column, mention: Column, symbol: Column) -> Column:
    """The first occurrence of ``mention``, whatever the case, as a whole word if there is one, else inside a word."""
    quoted = F.concat(F.lit(r"(?i)\Q"), mention, F.lit(r"\E"))
    word = F.concat(F.lit(r"(?i)\b\Q"), mention, F.lit(r"\E\b"))
    whole = F.split(text, F.when(mention.rlike(r"^[\p{L}\p{N}](.*[\p{L}\p{N}])?$"), word).otherwise(quoted), 2)
    loose = F.split(text, quoted, 2)
    put = lambda p: F.concat(F.get(p, F.lit(0)), symbol, F.get(p, F.lit(1)))
    return F.when(F.size(whole) == 2, put(whole)).when(F.size(loose) == 2, put(loose)).otherwise(text)


def replace_in_order(text: Column, pairs: Column) -> Column:
    """``pairs`` is an array of (mention, symbol); each works on what the ones before it left."""
    return F.aggregate(pairs, text, lambda acc, p: replace_first(acc, p["mention"], p["symbol"]))


def substitute(text: Column, pairs: Column) -> Column:
    """Every whole-word occurrence of each pair's ``old`` becomes its ``new``; longest first keeps c1 out of c10."""
    bound = lambda w: F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), w, F.lit(r"\E(?![A-Za-z0-9_])"))
    longest = F.array_sort(pairs, lambda a, b: F.length(b["old"]) - F.length(a["old"]))
    literal = lambda w: F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.aggregate(longest, text, lambda acc, p: F.regexp_replace(acc, bound(p["old"]), literal(p["new"])))


def extract_sql(reply: Column) -> Column:
    """The query in a model's reply: thoughts dropped, the first fenced block, from SELECT or WITH on; empty if there is none."""
    text = F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?is)<think>.*?</think>", ""))
    fence = r"(?is)```(?:sql)?\s*(.*?)```"
    text = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    start = F.regexp_extract(text, r"(?is)(?:^|\n)\s*((?:SELECT|WITH)\b.*)$", 1)
    query = F.regexp_replace(start, r"^\s+|[\s;]+$", "")
    return F.when(query.rlike(r"(?i)\bSELECT\b"), query).otherwise("")


def perplexity(log_probabilities: Column) -> Column:
    total = F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(log_probabilities) > 0, F.round(F.exp(-total / F.size(log_probabilities)), 4))


def difficulty(text: Column, n_tables: Column, n_values: Column) -> Column:
    hard = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in HARD_WORDS), F.lit(0))
    full = lambda n, most: F.least(n / most, F.lit(1.0))
    return F.round(F.least(0.25 * full(n_tables, 4) + 0.25 * full(n_values, 3) + 0.5 * full(hard, 3), F.lit(1.0)), 3)


def rung(score: Column) -> Column:
    return F.when(score < 0.35, "small").when(score < 0.70, "medium").otherwise("large")


def name_shaped(mention: Column, generic: Column) -> Column:
    """A title in front, or a capitalised word that is not among the ``generic`` ones (an array)."""
    words = find_all(mention, "[A-Za-zÀ-ÿ']+")
    capital = F.exists(words, lambda w: w.rlike(r"^\p{Lu}") & ~F.array_contains(generic, F.lower(w)))
    return (F.trim(mention) != "") & (F.trim(mention).rlike(TITLE) | capital)


def subspans(mention: Column, generic: Column, most: int = 6) -> Column:
    """Shorter spans of the mention, longest first then leftmost; spans of generic words alone are left out."""
    words = F.filter(F.split(F.trim(mention), r"\s+"), lambda w: w != "")
    n = F.size(words)
    none = F.array().cast("array<string>")
    span = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    every = F.when(n > 1, F.flatten(F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), span))).otherwise(none)
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,;:()]+|[.,;:()]+$", "")
    told = F.filter(every, lambda s: ~F.forall(F.split(s, " "), lambda w: F.array_contains(generic, bare(w))))
    return F.slice(F.array_distinct(told), 1, most)


def mention_kind(entity_type: Column, named: Column, significant: Column, exact: Column, covered: Column, column_shaped: Column) -> Column:
    """person, quantity, value or concept. ``significant`` counts telling words, ``exact`` is a stored value of two words or more."""
    return (
        F.when(entity_type == "person", F.when(named, "person").otherwise("concept"))
        .when(significant == 0, "quantity")
        .when(exact, "value")
        .when(covered, "concept")
        .when(column_shaped, "concept")
        .otherwise("value")
    )
