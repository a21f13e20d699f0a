"""Resolution of mentions to stored values and columns: prefix search, containment, misspellings, and column linking."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegate.functions import similarity as sim
from valuegate.functions import text as tx
from valuegate.operators.lookup import cosine, cosine_pairs, prefix_pairs, substring_pairs, unit_vectors
from valuegate.sources.folders import stored

LEAST, LEAST_FUZZY = 0.55, 0.80
CONTAINED, FUZZY, RESULTS, LINKS, DOCUMENTS = 5000, 20, 5, 4, 10
LEAST_LINK = 0.25
#: Texts and worked examples that meet in one unit.
TEXTS, EXAMPLES = 4096, 512
#: Documents and questions whose words meet as one product of matrices.
BLOCK_DOCUMENTS, BLOCK_QUERIES = 2048, 128
#: Places for the letters of a text.
LETTERS = 64


def _tokens(text: Column) -> Column:
    return F.filter(tx.find_all(tx.normalize(text), "[a-z0-9]+"), lambda t: F.length(t) > 1)


def prefix_candidates(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """(mention, value, ref, matched, n_tokens): values with tokens that begin with tokens of the mention.

    Distinct tokens meet distinct words by intervals of their sorted order; who holds them is joined afterwards.
    """
    asked = mentions.select("mention", F.array_distinct(_tokens(F.col("mention"))).alias("ts")).filter(F.size("ts") > 0)
    asked = asked.select("mention", F.size("ts").alias("n_tokens"), F.explode("ts").alias("token"))
    held = index.select("value", "ref", F.explode(F.array_distinct(_tokens(F.col("value")))).alias("word"))
    met = asked.join(prefix_pairs(asked, held), "token").join(held, "word")
    return met.groupBy("mention", "value", "ref", "n_tokens").agg(F.count_distinct("token").alias("matched"))


def scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.round(sim.similarity_of("mention", "value", tx.parts(F.col("value"))), 4))


def prefix_scored(mentions: DataFrame, index: DataFrame, least: float = LEAST) -> DataFrame:
    """(mention, value, ref, score, level) of the values that score enough: level 0 if they match all tokens, 1 if some. Every candidate is scored."""
    found = scored(prefix_candidates(mentions, index)).filter(F.col("score") >= least)
    return found.select("mention", "value", "ref", "score", F.when(F.col("matched") == F.col("n_tokens"), 0).otherwise(1).alias("level"))


def first_level(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's rows those of the least level."""
    return found.withColumn("first", F.min("level").over(Window.partitionBy(*keys))).filter(F.col("level") == F.col("first")).drop("first")


def search_prefix(mentions: DataFrame, index: DataFrame, least: float = LEAST) -> DataFrame:
    """(mention, value, ref, score): values that match all tokens and score enough; for mentions without any, those that match some."""
    return first_level(prefix_scored(mentions, index, least), ["mention"]).select("mention", "value", "ref", "score")


def search_contains(mentions: DataFrame, values: DataFrame, most: int = CONTAINED) -> DataFrame:
    """(mention, value, ref): distinct values that hold the mention, at most ``most`` of a column; case and outer blanks do not matter. An empty mention has none."""
    named = mentions.select("mention", F.lower(F.trim("mention")).alias("part")).distinct()
    held = values.select("value", "ref", F.lower("value").alias("text")).distinct()
    met = named.join(substring_pairs(named, held), "part").join(held, "text")
    order = Window.partitionBy("mention", "ref").orderBy("value")
    return met.select("mention", "value", "ref").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def _letters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def _times(text: Column, c: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, c, F.lit("")))


def _numbered(text: Column) -> Column:
    """The characters of a text, those that repeat told apart by a number: common characters of two texts are then common elements of two sets."""
    each = lambda c: F.transform(F.sequence(F.lit(1), _times(text, c)), lambda k: F.concat(c, k.cast("string")))
    return F.flatten(F.transform(_letters(text), each))


def _rarest_first(texts: DataFrame, rarity: DataFrame) -> DataFrame:
    """(low, keys): of each text its numbered characters, the rarest first."""
    each = texts.select("low", F.explode(_numbered(F.col("low"))).alias("key")).join(rarity, "key", "left")
    return each.groupBy("low").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("keys"))


def search_fuzzy(mentions: DataFrame, index: DataFrame, least: float = LEAST_FUZZY, most: int | None = FUZZY) -> DataFrame:
    """(mention, value, ref, score): values whose whole ratio reaches ``least``, the best ``most`` of a mention.

    A ratio r needs lengths within a factor of (2 - r) / r and r / 2 of all characters in common. Texts with t characters in
    common share one among the rarest of each, if all but t - 1 are taken: length and such a character are the join key, and
    frequent characters are hardly ever one. The bounds lose nothing; the common characters are counted before scoring.
    """
    size, low = F.length("low"), F.col("low")
    shortest = lambda n: F.ceil(n * (least / (2 - least)) - 1e-9)
    common = lambda n, m: F.ceil((n + m) * (least / 2) - 1e-9)
    values = index.select("value", "ref", F.lower("value").alias("low")).filter("low <> ''").distinct()
    texts = values.select("low").distinct()
    rarity = texts.select(F.explode(_numbered(low)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    rarity = stored(rarity, "rarity")
    theirs = _rarest_first(texts, rarity).withColumn("first", F.slice("keys.key", F.lit(1), (size - common(shortest(size), size) + 1).cast("int")))
    theirs = theirs.select(F.col("low").alias("other"), size.cast("long").alias("size"), F.explode("first").alias("key"))
    named = mentions.select("mention", F.lower("mention").alias("low")).filter("low <> ''").distinct()
    sizes = F.sequence(F.greatest(shortest(size), F.lit(1)), F.floor(size * ((2 - least) / least) + 1e-9))
    ours = _rarest_first(named.select("low").distinct(), rarity).withColumn("size", F.explode(sizes))
    ours = ours.select("low", "size", F.explode(F.slice("keys.key", F.lit(1), (size - common(size, F.col("size")) + 1).cast("int"))).alias("key"))
    shared = F.aggregate(_letters(low), F.lit(0), lambda acc, c: acc + F.least(_times(low, c), _times(F.col("other"), c)))
    met = ours.join(theirs, ["size", "key"]).select("low", "other").distinct().filter(2 * shared >= least * (size + F.length("other")) - 1e-9)
    near = met.withColumn("score", F.round(sim.ratio_of("low", "other"), 4)).filter(F.col("score") >= least)
    hits = near.join(named, "low").join(values.withColumnRenamed("low", "other"), "other")
    if most:
        order = Window.partitionBy("mention").orderBy(F.desc("score"), "value", "ref")
        hits = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return hits.select("mention", "value", "ref", "score")


def rank(found: DataFrame, scope: DataFrame | None = None, most: int = RESULTS) -> DataFrame:
    """(mention, value, ref, score, place): by score, then place of the column in the mention's scope, then length; one value a column."""
    if scope is not None:
        found = found.join(scope, ["mention", "ref"], "left")
    else:
        found = found.withColumn("position", F.lit(None).cast("int"))
    order = [F.desc("score"), F.coalesce("position", F.lit(1 << 20)), F.length("value"), "value", "ref"]
    one = found.withColumn("p", F.row_number().over(Window.partitionBy("mention", "ref").orderBy(*order))).filter("p = 1")
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("mention").orderBy(*order)))
    return placed.filter(F.col("place") <= most).select("mention", "value", "ref", "score", "place")


def value_search(mentions: DataFrame, index: DataFrame, tier_b: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """The cascade: prefixes, then columns resolved on demand, then misspellings, each for mentions that nothing was found for.

    ``scope`` (mention, ref, position) only orders; ``cascade`` searches within a scope.
    """
    found = search_prefix(mentions, index)
    left = mentions.join(found.select("mention").distinct(), "mention", "left_anti")
    if tier_b is not None:
        second = scored(search_contains(left, tier_b)).filter(F.col("score") >= LEAST).select("mention", "value", "ref", "score")
        left = left.join(second.select("mention").distinct(), "mention", "left_anti")
        found = found.unionAll(second)
    return rank(found.unionAll(search_fuzzy(left, index)), scope)


def within(values: DataFrame, refs: DataFrame) -> DataFrame:
    """``values`` of the columns in ``refs``. Values that are stored by column are read from the folders of these columns alone: the scan is pruned
    by what the small side holds when the query runs."""
    few = refs.select("ref").distinct().filter(F.col("ref") > "")  # pruning needs a side with a condition
    return values.join(F.broadcast(few), "ref").select(*values.columns)  # a column reference each: of the schema's size


def _beyond_prefixes(left: DataFrame, index: DataFrame, tier_b: DataFrame | None) -> DataFrame:
    """(mention, value, ref, score, level): what columns resolved on demand (2) and misspellings (3) give."""
    found = search_fuzzy(left, index, most=None).withColumn("level", F.lit(3))
    if tier_b is not None:
        held = scored(search_contains(left, tier_b)).filter(F.col("score") >= LEAST)
        found = found.unionAll(held.select("mention", "value", "ref", "score", F.lit(2)))
    return found


def cascade(asked: DataFrame, index: DataFrame, scope: DataFrame, tier_b: DataFrame | None = None) -> DataFrame:
    """(type, mention, value, ref, score, position, scoped): what each mention of a type may be.

    ``scope`` has the columns (type, ref, position) that a type is looked for in. Within them prefixes go first, then columns
    resolved on demand, then misspellings; only if all of them find nothing there, the same is done in all columns. The first
    part reads the columns of the asked types alone.
    """
    keys, asked = ["type", "mention"], asked.select("type", "mention").distinct()
    mentions = lambda rows: rows.select("mention").distinct()
    limited = asked.join(scope.select("type").distinct(), "type", "left_semi")
    refs = stored(scope.join(asked.select("type").distinct(), "type", "left_semi").select("ref").distinct(), "scope")
    near, near_b = within(index, refs), None if tier_b is None else within(tier_b, refs)
    placed = lambda pairs, found: pairs.join(found, "mention").join(scope, ["type", "ref"])
    first = placed(limited, prefix_scored(mentions(limited), near))
    first = stored(first.select(*keys, "value", "ref", "score", "level", "position"), "scoped-prefix-hits")
    open_ = limited.join(first.select(*keys).distinct(), keys, "left_anti")
    inside = first.unionByName(placed(open_, _beyond_prefixes(mentions(open_), near, near_b)).select(first.columns)).withColumn("scoped", F.lit(True))
    inside = stored(inside, "scoped-hits")
    rest = stored(asked.join(inside.select(*keys).distinct(), keys, "left_anti"), "unscoped")
    anywhere = stored(prefix_scored(mentions(rest), index), "prefix-hits")
    open_ = mentions(rest).join(mentions(anywhere), "mention", "left_anti")
    outside = rest.join(anywhere.unionByName(_beyond_prefixes(open_, index, tier_b)), "mention")
    outside = outside.select(*keys, "value", "ref", "score", "level", F.lit(None).cast("int").alias("position"), F.lit(False).alias("scoped"))
    met = first_level(inside.withColumn("position", F.col("position").cast("int")).unionByName(outside), keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "value", "ref")
    met = met.withColumn("place", F.row_number().over(order)).filter((F.col("level") < 3) | (F.col("place") <= FUZZY))
    return met.select(*keys, "value", "ref", "score", "position", "scoped")


def trigram_vectors(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, vector): the trigrams of a text as a unit vector."""
    return unit_vectors(rows, keys, tx.trigrams(text))


def link_columns(mentions: DataFrame, cards: DataFrame, heads: DataFrame, most: int = LINKS) -> DataFrame:
    """(mention, ref, score): the columns that a mention may name, best first.

    A synonym is certain; else three quarters of the likeness to table and column, or to a synonym at 0.6, and a quarter of
    that to the column alone; a head word with another word in the names gives 0.9 at least.

    A score that counts needs one of the likenesses to reach it, a synonym or a head word: pairs are met by these, and only those
    are scored. The cards grow with the schema, the mentions with the texts.
    """
    from valuegate.operators.profile import names_a_column

    asked = stored(trigram_vectors(mentions.select("mention").distinct(), ["mention"], F.col("mention")), "mention-vectors")
    named = cards.select("ref", F.explode("synonyms").alias("synonym")).distinct()
    surface = trigram_vectors(cards, ["ref"], F.concat_ws(" ", "table_name", "column_name"))
    own = trigram_vectors(cards, ["ref"], F.col("column_name"))
    partial = trigram_vectors(named, ["ref", "synonym"], F.col("synonym"))
    least = LEAST_LINK - 1e-4  # the score is rounded before it is compared
    plain = F.array_join(tx.find_all(F.lower("mention"), "[a-z0-9]+"), " ")
    headed = names_a_column(mentions, heads)
    ends = F.flatten(F.transform(F.sequence(F.lit(1), F.length("column_name")), lambda i: F.transform(F.sequence(F.lit(3), F.lit(10)), lambda n: F.substring(F.col("column_name"), i, n))))
    met = [
        cosine_pairs(asked, "mention", surface, ["ref"], least).select("mention", "ref"), cosine_pairs(asked, "mention", own, ["ref"], least).select("mention", "ref"),
        cosine_pairs(asked, "mention", partial, ["ref", "synonym"], least / 0.6).select("mention", "ref"),
        mentions.select("mention", plain.alias("s")).join(named.select("ref", F.lower("synonym").alias("s")), "s").select("mention", "ref"),
        headed.join(cards.select("ref", F.explode(F.array_distinct(ends)).alias("head")), "head").select("mention", "ref"),
    ]
    pairs = reduce(DataFrame.unionAll, met).distinct().join(asked.withColumnRenamed("vector", "m"), "mention", "left")
    for vectors, name in ((surface, "v1"), (own, "v2"), (partial.groupBy("ref").agg(F.collect_list("vector").alias("vector")), "v3")):
        pairs = pairs.join(vectors.withColumnRenamed("vector", name), "ref", "left")
    likest = F.coalesce(F.array_max(F.transform("v3", lambda v: cosine(F.col("m"), v))), F.lit(0.0))
    score = 0.75 * F.greatest(cosine(F.col("m"), F.col("v1")), 0.6 * likest) + 0.25 * cosine(F.col("m"), F.col("v2"))
    pairs = pairs.select("mention", "ref", score.alias("base")).join(cards, "ref").join(headed, "mention", "left")
    words = F.split(plain, " ")
    context = F.filter(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), lambda w: F.length(w) > 3)
    by_head = F.col("head").isNotNull() & F.contains("column_name", "head") & F.exists(context, lambda w: F.contains(F.col("table_name"), w) | F.contains(F.col("column_name"), w))
    certain = F.exists("synonyms", lambda s: F.lower(s) == plain)
    final = F.round(F.when(certain, 1.0).when(F.coalesce(by_head, F.lit(False)), F.greatest("base", F.lit(0.9))).otherwise(F.col("base")), 4)
    order = Window.partitionBy("mention").orderBy(F.desc("score"), F.length("ref"), "ref")
    return pairs.select("mention", "ref", final.alias("score")).filter(F.col("score") >= LEAST_LINK).withColumn("p", F.row_number().over(order)).filter(F.col("p") <= most).drop("p")


def _letters_of(words: set[str]) -> np.ndarray:
    """How often each letter occurs in the words joined by blanks; letters that share a place only raise a bound."""
    text = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    return np.bincount(text % LETTERS, minlength=LETTERS)


def _nearest(most: int):
    """Of each text of a unit the best of its examples that share a word with it.

    The lengths of shared words and the letters in common bound a pair's ratio from above, for all examples of the unit at once.
    Examples are visited by falling bound, until none that is left can reach the last of the best.
    """

    def run(texts: pd.DataFrame, examples: pd.DataFrame) -> pd.DataFrame:
        plain = lambda text: " ".join(text.split()).lower()
        known = [(e, plain(e), set(e.split())) for e in examples["example"]]
        holders = defaultdict(list)
        for i, (_, _, words) in enumerate(known):
            for word in words:
                holders[word].append(i)
        letters = np.array([_letters_of(words) for _, _, words in known]).reshape(len(known), LETTERS)
        sizes = letters.sum(axis=1)
        rows = []
        for id_, text in zip(texts["id"], texts["text"], strict=True):
            own, words, shared = plain(text), set(text.split()), np.zeros(len(known), np.int64)
            for word in words:
                shared[holders.get(word, [])] += len(word) + 1
            met = np.flatnonzero(shared)
            mine = _letters_of(words)
            both, size, its = shared[met] - 1, int(mine.sum()), sizes[met]
            alike = 2 * np.minimum(mine, letters[met]).sum(axis=1) / np.maximum(size + its, 1)
            bound = np.maximum.reduce([alike, 2 * both / (both + size), 2 * both / (both + its)])
            best: list[tuple[float, str]] = []
            for j in np.argsort(-bound, kind="stable"):
                if len(best) == most and round(bound[j] + 1e-9, 4) < -best[-1][0]:
                    break
                example, low, _ = known[met[j]]
                if low != own:
                    best = sorted([*best, (-round(sim.token_set(text, example), 4), example)])[:most]
            rows += [(id_, example, -score) for score, example in best]
        return pd.DataFrame(rows, columns=["id", "example", "score"])

    return run


def nearest_examples(texts: DataFrame, examples: DataFrame, leaked: DataFrame, most: int = 3) -> DataFrame:
    """(id, example, score): the nearest examples by token-set ratio, never the text itself, never one that holds a stored value.

    All texts are asked against all examples, in units of ``TEXTS`` and ``EXAMPLES``. A unit gives each text its best few,
    so no pair becomes a row and no word is a key. Examples without a word of the text would score lowest and do not count.
    """
    usable = examples.select("example").filter("example IS NOT NULL").distinct().join(leaked.select("example").distinct(), "example", "left_anti")
    usable, asked = stored(usable, "usable-examples"), texts.select("id", "text").filter("text IS NOT NULL").distinct()
    blocks, shares = (max(1, -(-df.count() // n)) for df, n in ((usable, EXAMPLES), (asked, TEXTS)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("share", dealt(shares, "id", "text")).withColumn("block", every(blocks))
    right = usable.withColumn("block", dealt(blocks, "example")).withColumn("share", every(shares))
    kind = f"id {texts.schema['id'].dataType.simpleString()}, example string, score double"
    hits = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInPandas(_nearest(most), kind)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "example")
    return hits.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= most).select("id", "example", "score")


def _document_blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc, dl, terms) as blocks of ``BLOCK_DOCUMENTS``, one row each."""
    for frame in frames:
        for a in range(0, frame.num_rows, BLOCK_DOCUMENTS):
            part = frame.slice(a, BLOCK_DOCUMENTS)
            terms = part.column("terms")
            flat = terms.flatten()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([one(part.column("doc")), one(part.column("dl")), one(pc.list_value_length(terms).cast(pa.int32())), one(flat.field("number")), one(flat.field("tf"))], ["docs", "dls", "counts", "numbers", "tfs"])


def _block_scores(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block of documents met by a block of queries: each query's best documents, as one product of matrices."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                docs, asked = frame.column("docs")[i].values, frame.column("asked")[i].values
                dls, counts, numbers, tfs = (frame.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("dls", "counts", "numbers", "tfs"))
                avgdl = frame.column("avgdl")[i].as_py()
                words, column = np.unique(asked.field("number").to_numpy(zero_copy_only=False), return_inverse=True)
                queries = pc.dictionary_encode(asked.field("query"), null_encoding="encode")
                weight = np.zeros((len(words), len(queries.dictionary)))
                weight[column, queries.indices.to_numpy(zero_copy_only=False)] = asked.field("idf").to_numpy(zero_copy_only=False)
                row, place = np.repeat(np.arange(len(docs)), counts), np.minimum(np.searchsorted(words, numbers), len(words) - 1)
                mine = words[place] == numbers
                row, place, tf = row[mine], place[mine], tfs[mine]
                held = np.zeros((len(docs), len(words)))
                held[row, place] = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dls[row] / avgdl))
                score = (held @ weight).T
                order = np.empty(len(docs), np.int64)
                order[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
                first = np.lexsort((np.broadcast_to(order, score.shape), -np.round(score, 6)), axis=1)[:, :most]
                best = np.take_along_axis(score, first, 1)
                which, nth = np.nonzero(best > 0)  # every idf is above 0
                yield pa.RecordBatch.from_arrays([queries.dictionary.take(pa.array(which)), docs.take(pa.array(first[which, nth])), pa.array(best[which, nth])], ["query", "doc", "score"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """(query, doc, score): the best documents by BM25 over (query, token) and (doc, token) rows, tokens repeated as they occur.

    Documents are read once: what they hold of the words asked for is counted and stored. Blocks of documents meet blocks of
    queries in numpy and give each query its best of the block, so no pair of query and document becomes a row.
    """
    queries = stored(queries.distinct(), "queries")
    words = stored(queries.select("token").distinct().withColumn("number", F.monotonically_increasing_id()), "query-words")
    counted = docs.join(words, "token", "left").groupBy("doc", "number").agg(F.count("*").alias("tf"))  # words not asked for are one row
    term = F.when(F.col("number").isNotNull(), F.struct("number", F.col("tf").cast("double").alias("tf")))
    held = stored(counted.groupBy("doc").agg(F.sum("tf").cast("double").alias("dl"), F.collect_list(term).alias("terms")), "document-words")
    whole = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    df = held.select(F.explode("terms.number").alias("number")).groupBy("number").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))
    idf = df.select("number", "avgdl", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    n_blocks = queries.select("query").distinct().count() // BLOCK_QUERIES + 1
    asked = queries.join(words, "token").join(idf, "number").groupBy(F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block"))
    asked = asked.agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("query", "number", "idf")).alias("asked")).drop("block")
    kind, of = (f.schema[c].dataType.simpleString() for f, c in ((docs, "doc"), (queries, "query")))
    blocks = held.filter("doc is not null").mapInArrow(_document_blocks, f"docs array<{kind}>, dls array<double>, counts array<int>, numbers array<long>, tfs array<double>")
    best = blocks.crossJoin(stored(asked, "query-blocks")).mapInArrow(_block_scores(most), f"query {of}, doc {kind}, score double").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return best.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= most).select("query", "doc", "score")
