"""The gate: does an outgoing text hold values of the data, and is each part of a message what it claims to be?"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegate.operators.bloom import Bloom
from valuegate.operators.bloom import build as build_bloom
from valuegate.operators.index import NGRAM_CEILING, carries_information
from valuegate.sources.local import local_rows

#: Stored values that are sent to every task; the index has a bound for each column, so more than this needs hundreds of columns.
SENT_VALUES = 200_000

#: How texts are cut into tokens, and into the words that make up stored values.
TOKEN = r":v\d+|[A-Za-zÀ-ÿ_][A-Za-zÀ-ÿ0-9_]*|[-+]?\d+(?:[.,]\d+)?%?|\S"
WORD = r"[A-Za-zÀ-ÿ0-9+&/.-]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
SLOT = r"(?<![A-Za-z0-9_])(?:[tc]\d+(?:\.[tc]\d+)?|\d+)(?![A-Za-z0-9_])"
DDL = "create table int real text blob numeric rows primary key foreign references".split()
#: Tokens of these shapes are allowed (symbols, numbers, punctuation and short aliases).
PATTERNS = [r"^:v\d+$", r"^[-+]?\d+([.,]\d+)?%?$", r"^[^A-Za-zÀ-ÿ0-9]+$", r"^[a-z]\d?$"]
#: The names of rules in verdicts and journals.
DENYLIST, MEMBERSHIP = "known-value denylist", "value-token membership"
RULES = {
    "authored": "registered constant", "template": "authored template, labels only", "schema": "schema identifiers only",
    "params": "bound-parameter declarations", "opaque": "opaque labels only", "glossary": "declared glossary note",
}


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def denied_values(exact: DataFrame, exempt: DataFrame) -> DataFrame:
    """(value, size): what counts as a stored value in a text. A single word does not if it is exempt or carries no information; nor do values of over 32 words."""
    sized = exact.select("value", F.size(F.split("value", " ")).alias("size")).filter(F.col("size") <= NGRAM_CEILING)
    told = (F.col("size") > 1) | carries_information(F.col("value"))
    one = exempt.select(F.col("word").alias("value"), F.lit(1).alias("size"))
    return sized.filter(told).join(one, ["value", "size"], "left_anti")


def denied_tokens(value_tokens: DataFrame, allowed: DataFrame) -> DataFrame:
    """(token): words of stored values that carry information and are not allowed."""
    return value_tokens.select("token").filter(carries_information(F.col("token"))).join(allowed.select(F.col("word").alias("token")), "token", "left_anti")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _node(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a node of the trie of stored values: that of the node before it, and one word (its hash) more. The root is 0."""
    return _mixed(before * np.uint64(0x9E3779B97F4A7C15) ^ word)


def _end(node: np.ndarray) -> np.ndarray:
    """The key of a node where a stored value ends."""
    return _mixed(~node)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists of hashes, and where each list begins and ends."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0]


def _listed(values: pa.Array, row: np.ndarray, n: int) -> pa.Array:
    """``values`` as one list for each of ``n`` rows; ``row`` is sorted."""
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), values)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _path(words: pa.Array) -> pa.Array:
    """The nodes that a value's words lead through, and its end."""
    flat, bounds = _flat(words)
    size = np.diff(bounds)
    rows, keys = [], []
    node = np.zeros(len(size), np.uint64)
    for i in range(size.max(initial=0)):
        live = np.flatnonzero(size > i)
        node[live] = _node(node[live], flat[bounds[live] + i])
        rows.append(live)
        keys.append(node[live])
    rows, keys = np.concatenate([*rows, np.arange(len(size))]), np.concatenate([*keys, _end(node)])
    order = np.argsort(rows, kind="stable")
    return _listed(pa.array(keys[order].view(np.int64)), rows[order], len(size))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


@dataclass(frozen=True)
class Denylist:
    """Stored values and words as tables, and as two filters that texts are tested by where they stand.

    ``trie`` holds every beginning of every value and marks the ends; ``words`` holds the tokens.
    """

    values: DataFrame
    tokens: DataFrame
    trie: Bloom
    words: Bloom
    longest: int
    small: bool


FILTERS = "trie binary, words binary, longest int, n long"


def filters(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row of ``FILTERS`` for stored tables of ``denied_values`` and ``denied_tokens``; its size has a bound."""
    row = values.agg(F.count("*").alias("n"), F.max("size").alias("longest")).first()
    nodes = values.select(_path(_hashes(F.split("value", " "))).alias("path")).select(F.explode("path").alias("key")).distinct()
    trie, words = build_bloom(nodes), build_bloom(tokens.select(F.xxhash64("token").alias("key")))
    return local_rows(values.sparkSession, [(trie.data, words.data, row["longest"] or 0, row["n"])], FILTERS)


def denylist(values: DataFrame, tokens: DataFrame, made: DataFrame | None = None) -> Denylist:
    """``made`` are the tables' ``filters``, if they were kept."""
    row = (filters(values, tokens) if made is None else made).first()
    return Denylist(values, tokens, Bloom(bytes(row["trie"])), Bloom(bytes(row["words"])), row["longest"], row["n"] <= SENT_VALUES)


def trie_matches(words: Column, deny: Denylist) -> Column:
    """array<struct<size, value>>: stretches of ``words`` that seem to be stored values.

    From every word on the trie is walked one word further a step, by those stretches alone that still begin a value; so a text makes
    as many stretches as its words begin values, not one for each length at each word.
    """
    trie, longest = deny.trie, deny.longest

    @F.arrow_udf("array<struct<at:int,size:int>>")
    def walk(words: pa.Array) -> pa.Array:
        flat, bounds = _flat(words)
        row = np.repeat(np.arange(len(words)), np.diff(bounds))
        start, node = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        found = [(start[:0], start[:0])]
        for size in range(1, longest + 1):
            inside = start + size <= bounds[row[start] + 1]
            start, node = start[inside], node[inside]
            node = _node(node, flat[start + size - 1])
            seen = trie.holds(node)
            start, node = start[seen], node[seen]
            if not len(start):
                break
            ends = start[trie.holds(_end(node))]
            found.append((ends, np.full(len(ends), size)))
        start, size = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start, kind="stable")
        start, size = start[order], size[order]
        places = pa.StructArray.from_arrays([pa.array((start - bounds[row[start]]).astype(np.int32)), pa.array(size.astype(np.int32))], ["at", "size"])
        return _listed(places, row[start], len(words))

    named = lambda f: F.struct(f["size"].alias("size"), F.array_join(F.slice(words, f["at"] + 1, f["size"]), " ").alias("value"))
    return F.array_distinct(F.transform(walk(_hashes(words)), named))


def known_values(texts: DataFrame, deny: Denylist) -> DataFrame:
    """(id, value, size): stored values among the words of ``texts`` (id, text).

    Stretches are found in each text by itself, in one narrow pass; only those become rows, and meet the stored values. Up to
    ``SENT_VALUES`` values go to the texts, which then are not shuffled.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD.replace("A-Z", "")), F.lit(0))
    found = texts.select("id", words.alias("ws")).select("id", F.explode(trie_matches(F.col("ws"), deny)).alias("g")).select("id", "g.size", "g.value")
    values = F.broadcast(deny.values) if deny.small else deny.values
    return found.join(values, ["value", "size"], "left_semi").select("id", "value", "size")


def refused_tokens(texts: DataFrame, deny: Denylist) -> DataFrame:
    """(id, token, place): tokens that are not allowed, carry information and occur in short stored values; the first spelling of each.

    Tokens are tested against the filter and the allowed shapes before any becomes a row.
    """
    words = deny.words

    @F.arrow_udf("array<int>")
    def likely(tokens: pa.Array) -> pa.Array:
        flat, bounds = _flat(tokens)
        held = np.flatnonzero(words.holds(flat))
        row = np.searchsorted(bounds, held, "right") - 1
        return _listed(pa.array((held - bounds[row]).astype(np.int32)), row, len(tokens))

    tokens = texts.select("id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("ts"))
    places = likely(F.transform("ts", lambda t: F.xxhash64(F.lower(t))))
    each = F.transform(places, lambda i: F.struct(i.alias("place"), F.get("ts", i).alias("token"), F.lower(F.get("ts", i)).alias("key")))
    shaped = lambda t: reduce(Column.__or__, [t.rlike(p) for p in PATTERNS])
    rows = tokens.select("id", F.explode(each).alias("t")).select("id", "t.*").filter(~shaped(F.col("token")))
    first = rows.groupBy("id", "key").agg(F.min(F.struct("place", "token")).alias("t"))
    return first.join(deny.tokens.select(F.col("token").alias("key")), "key", "left_semi").select("id", "t.token", "t.place")


def verdicts(texts: DataFrame, known: DataFrame, refused: DataFrame) -> DataFrame:
    """(id, allowed, refused, n_tokens, fingerprint, rule) of every text: known values go before tokens."""
    one = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "value"))).alias("k")).select("id", F.col("k.value").alias("values"))
    two = refused.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("r")).select("id", F.col("r.token").alias("tokens"))
    text = F.coalesce("text", F.lit(""))
    # What is told of a text is worked out first, so that texts are never shuffled.
    told = texts.select("id", F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("n_tokens"), fingerprint(text).alias("fingerprint"))
    joined = told.join(one, "id", "left").join(two, "id", "left")
    return joined.select(
        "id", (F.col("values").isNull() & F.col("tokens").isNull()).alias("allowed"), F.coalesce("values", "tokens", F.array().cast("array<string>")).alias("refused"), "n_tokens", "fingerprint",
        F.when(F.col("values").isNotNull(), DENYLIST).otherwise(MEMBERSHIP).alias("rule"),
    )


def templated(text: Column) -> Column:
    """The text with labels and numbers blanked and white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, SLOT, "\u0001"), r"\s+", " "))


def parameter_line(line: Column) -> Column:
    """(ok, names) of a line that declares a bound parameter: whether it has one of the three forms, and the table and column it names.

    Fixed values: the forms' wording.
    """
    symbol = F.substring_index(line, " = ", 1)
    tail = F.rtrim(F.substring(line, F.length(symbol) + 4, F.length(line)))
    one, many, advice = "a value of ", "a LIKE pattern for ", r"^match it with LIKE :v\d+, never with =$"
    is_one, is_many = tail.startswith(one), tail.startswith(many)
    rest = F.when(is_one, F.substring(tail, F.lit(len(one) + 1), F.length(tail))).when(is_many, F.substring(tail, F.lit(len(many) + 1), F.length(tail))).otherwise("")
    ref = F.when(is_many, F.substring_index(rest, " - ", 1)).otherwise(rest)
    advised = ~is_many | F.substring(rest, F.length(ref) + 4, F.length(rest)).rlike(advice)
    declared = (tail == "a number given by the analyst") | ((is_one | is_many) & ref.rlike(r"^[A-Za-z0-9_]+\.[A-Za-z0-9_]+$") & advised)
    return F.struct((F.trim(symbol).rlike(r"^:v\d+$") & declared).alias("ok"), F.when(ref == "", F.array().cast("array<string>")).otherwise(F.split(ref, r"\.")).alias("names"))


def provenance(segments: DataFrame, constants: DataFrame, templates: DataFrame, identifiers: DataFrame, notes: DataFrame) -> DataFrame:
    """``segments`` (id, part, origin, text) with ``rule``: what shows that the part is what it claims to be, null if nothing does.

    ``constants`` and ``templates`` have the digest of their text, ``identifiers`` a word, ``notes`` a note.
    """
    text = F.coalesce("text", F.lit(""))
    # What a part claims to be decides what is worked out of it.
    of = lambda *origins: F.col("origin").isin(*origins)
    rows = segments.withColumns(
        {
            "digest": F.when(of("authored"), F.sha2(text, 256)),
            "template": F.when(of("template"), F.sha2(templated(text), 256)),
            "words": F.when(of("schema", "opaque"), F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))),
            "note": F.when(of("glossary"), F.trim(text)),
        }
    )
    flag = lambda df, column, name: df.select(F.col(df.columns[0]).alias(column)).distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(constants, "digest", "is_constant"), "digest", "left").join(flag(templates, "template", "is_template"), "template", "left").join(flag(notes, "note", "is_note"), "note", "left")
    lines = F.filter(F.split(F.when(of("params"), text), "\n"), lambda x: F.trim(x) != "")
    stated = F.transform(lines, parameter_line)
    named = F.flatten(F.transform(stated, lambda p: p["names"]))
    label = lambda w: w.rlike(r"^[tc]\d+$")
    named = F.filter(named, lambda w: ~label(w))
    plain = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: ~w.isin(DDL))
    # The words that have to be identifiers are looked up where the part stands: there are as many identifiers as the schema names.
    words = [r["word"] for r in identifiers.select("word").distinct().collect()]
    known = F.forall(F.when(of("schema"), plain).otherwise(named), lambda w: w.isin(words))
    block = (F.size(lines) > 0) & ((F.array_join(lines, "\n") == "  (none)") | (F.forall(stated, lambda p: p["ok"]) & known))
    opaque = (F.size("words") > 0) & F.forall("words", lambda w: label(w) | F.lower(w).isin(DDL))
    holds = {
        "authored": F.col("is_constant").isNotNull(), "template": F.col("is_template").isNotNull(), "schema": F.contains(text, F.lit("CREATE TABLE")) & known,
        "params": block, "opaque": opaque, "glossary": (F.col("note") != "") & F.col("is_note").isNotNull(),
    }
    rule = reduce(lambda acc, o: acc.when((F.col("origin") == o) & holds[o], RULES[o]), holds, F.when(F.lit(False), ""))
    return rows.select("id", "part", "origin", "text", rule.alias("rule"))


def message_verdicts(parts: DataFrame, checked: DataFrame) -> DataFrame:
    """(id, allowed, refused): a message is blocked if a part without a rule of its own is refused.

    ``checked`` has the verdicts of those parts as (id, part, allowed, refused).
    """
    loose = parts.filter("rule is null").select("id", "part").join(checked, ["id", "part"], "left")
    none = F.array().cast("array<string>")
    # Parts with a rule need no verdict; of those only the message's id is shuffled.
    ruled = parts.filter("rule is not null").groupBy("id").agg(F.lit(True).alias("ok")).withColumn("words", none)
    each = loose.select("id", F.coalesce("allowed", F.lit(False)).alias("ok"), F.coalesce("refused", none).alias("words")).unionAll(ruled)
    return each.groupBy("id").agg(F.bool_and("ok").alias("allowed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("refused"))
