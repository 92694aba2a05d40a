"""Keyword, phrase, fuzzy, vector and context search over the text index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.clean import strip
from lexweave.functions.stem import STOP_WORDS, lexemes, stemmed, stems  # noqa: F401  stems is offered here too
from lexweave.operators.text import SECTIONS, index_counters, ngrams, paragraph_list, sentence_list, tokens, with_sections, with_sentences


def holding(rows: DataFrame, words: list[str], lexemes: Callable[[Column], Column] = tokens) -> DataFrame:
    """The rows whose text has all the words as lexemes, exact tokens by default. No row leaves its place; blank queries match nothing."""
    wanted = sorted({w.lower() for w in words if w.strip()})
    if not wanted:
        return rows.filter(F.lit(False))
    low = F.lower("text")
    near = rows
    if lexemes is tokens:
        for w in wanted:  # cheaper than cutting the text into tokens
            near = near.filter(low.contains(w))
    worded = near.withColumn("__w", F.explode(F.array(lexemes(F.col("text")))))
    test = F.array_contains("__w", wanted[0])
    for w in wanted[1:]:
        test = test & F.array_contains("__w", w)
    return worded.filter(test).drop("__w")


def stemmed_query(query: str) -> list[str]:
    """The stems of a query's words in order, without stop words."""
    found = re.findall(r"[^\W_]+(?:['-][^\W_]+)*", query.lower())
    return [stemmed(w) for w in found if w not in STOP_WORDS]


def holding_stems(rows: DataFrame, query: str) -> DataFrame:
    """The rows whose text has all the query's words, whatever their endings; stop words don't count."""
    return holding(rows, stemmed_query(query), lambda text: lexemes(tokens(text)))


def phrase_starts(rows: DataFrame, phrase: list[str], lexemes: Callable[[Column], Column] = tokens, followed: int = 0) -> DataFrame:
    """Rows with start, each place (from 0) where the words follow each other among the text's lexemes, and ``followed`` more come after them."""
    low = [w.lower() for w in phrase]
    if not low:
        return rows.withColumn("start", F.lit(0)).filter(F.lit(False))
    near = rows
    if lexemes is tokens:
        for w in low:
            near = near.filter(F.lower("text").contains(w))
    worded = near.withColumn("__w", F.explode(F.array(lexemes(F.col("text"))))).filter(F.size("__w") >= len(low) + followed)

    def here(i: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.get("__w", i + k) == F.lit(w) for k, w in enumerate(low)])

    places = F.filter(F.sequence(F.lit(0), F.size("__w") - len(low) - followed), here)
    return worded.withColumn("start", F.explode(places)).drop("__w")


def boolean_query(query: str, lexemes: Column) -> Column:
    """A query of words, &, |, ! and parentheses as a test of an array of lexemes. A malformed query is an error."""
    parts = re.findall(r"[&|!()]|[^\s&|!()]+", query)

    def next_part() -> str:
        if not parts:
            raise ValueError(f"query ends early: {query!r}")
        return parts.pop(0)

    def either() -> Column:
        left = both()
        while parts and parts[0] == "|":
            parts.pop(0)
            left = left | both()
        return left

    def both() -> Column:
        left = one()
        while parts and parts[0] not in ("|", ")"):
            if parts[0] == "&":
                parts.pop(0)
            left = left & one()
        return left

    def one() -> Column:
        x = next_part()
        if x == "!":
            return ~one()
        if x == "(":
            inner = either()
            if next_part() != ")":
                raise ValueError(f"parenthesis isn't closed: {query!r}")
            return inner
        if x in ("&", "|", ")"):
            raise ValueError(f"word expected before {x!r}: {query!r}")
        return F.array_contains(lexemes, x.lower())

    found = either()
    if parts:
        raise ValueError(f"parenthesis isn't opened: {query!r}")
    return found


def web_query(query: str, lexemes: Column) -> Column:
    """Quoted words follow each other, "or" parts alternatives, a minus excludes. An "or" without words on both sides counts for nothing; an empty query matches nothing."""
    text = F.concat(F.lit(" "), F.array_join(lexemes, " "), F.lit(" "))
    options: list[list[Column]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            options.append([])
            continue
        words = re.findall(r"[^\W_]+(?:['-][^\W_]+)*", (quoted or word).lower())
        if words:
            test = text.contains(f" {' '.join(words)} ")
            options[-1].append(~test if minus else test)
    tests = [reduce(lambda x, y: x & y, o) for o in options if o]
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(False)


def rank(lexemes: Column, words: list[str]) -> Column:
    """R5, an approximation of a rank: the sum of the words' log frequencies over the log of the length."""

    def frequency(word: str) -> Column:
        return F.size(F.filter(lexemes, lambda x: x == F.lit(word)))

    total = reduce(lambda x, y: x + y, [F.log1p(frequency(w).cast("double")) for w in words])
    return total / (F.lit(1.0) + F.log1p(F.size(lexemes).cast("double")))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-case words with two blanks before and one after each."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    # Letters as arrays: a substring is searched from the start of its word, so that long words took time in the square of their length.
    letters = F.transform(words, lambda w: F.split(F.concat(F.lit("  "), w, F.lit(" ")), ""))
    return F.array_distinct(F.flatten(F.transform(letters, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2])))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams."""

    def of(p: Column) -> Column:
        shared = F.size(F.array_intersect(p["x"], p["y"]))
        union = F.size(p["x"]) + F.size(p["y"]) - shared
        return F.when(union > 0, shared / union).otherwise(0.0)

    return F.get(F.transform(F.array(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y"))), of), 0)  # as an element, so that trigrams are made once


def around(rows: DataFrame, hits: DataFrame, order: str, before: int = 1, after: int = 1) -> DataFrame:
    """Rows of a hit's document within reach: those columns, target, distance, place. ``hits``: id and ``order``."""
    near = hits.select(F.col("id").alias("h"), F.col(order).alias("target"))
    joined = rows.join(near, (F.col("id") == F.col("h")) & F.col(order).between(F.col("target") - before, F.col("target") + after)).drop("h")
    gap = F.col(order) - F.col("target")
    return joined.withColumn("distance", F.abs(gap)).withColumn("place", F.when(gap < 0, "BEFORE").when(gap > 0, "AFTER").otherwise("TARGET"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(vectors: DataFrame, query: DataFrame | list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows most similar to a query vector, the lower id first among equals. The vector is given, or the one row of a table, which is read as the query runs."""
    own = vectors.sparkSession.createDataFrame([(query,)], "v array<double>") if isinstance(query, list) else query.toDF("v")
    one = own.limit(1).select(F.transform("v", lambda x: x.cast("double")).alias("__v"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    met = vectors.join(F.broadcast(one.withColumn("__n", length(F.col("__v")))))
    dot = F.aggregate(F.zip_with(vec_col, "__v", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, v: t + v)
    norm = length(F.col(vec_col)) * F.col("__n")
    return met.select(id_col, F.round(F.when(norm > 0, dot / norm), 6).alias("similarity")).orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)


def ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """id, rank (from 1) of the first k rows; only those meet in one task."""
    return rows.orderBy(*order).limit(k).select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fused(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """Id, score: the sum of 1 / (k + rank) over rankings of (id, rank)."""
    rows = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        rows = rows.union(r.select("id", "rank"))
    return rows.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """O1: the first k in a total order."""
    return rows.orderBy(*order).limit(k)


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def _partial(a: str, b: str) -> int:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    best = 0.0
    for block in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        at = max(block.b - block.a, 0)
        best = max(best, SequenceMatcher(None, short, long[at : at + len(short)], autojunk=False).ratio())
    return round(100 * best)


@F.pandas_udf(T.IntegerType())
def partial_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How alike the shorter text and its best-aligned part of the longer are, 0 to 100."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else _partial(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _shared(length: Column) -> Column:
    """Neighbouring letter pairs that a text of ``length`` letters shares at the least with one as long or longer at a partial ratio that rounds to 80."""
    # Of T characters of both, 0.3975 T match at the least, and 0.205 T don't, so that they lie in 0.205 T + 1 runs
    # at the most; T is 1.66 lengths or more. A run of n letters keeps n - 1 pairs.
    return F.ceil(F.lit(0.3195) * length - 1).cast("int")


def fuzzy_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: int = 80) -> DataFrame:
    """Pairs whose partial ratio is ``least`` (80 or more) or higher; blank and null texts have no partners.

    The shorter of two such texts shares a known number of its neighbouring letter pairs with the
    longer. Its pairs are put in order of their rarity, and as many of the rarest as must hold a shared
    one are joined with the longer text's pairs; the commonest never are. A shorter text of up to 3
    letters shares one of them. Texts that meet so are scored, each two once, and none is lost.
    """
    if least < 80:
        raise ValueError("least must be 80 or more")

    def side(rows: DataFrame, column: str, number: str) -> DataFrame:
        own = rows.filter(F.length(F.trim(F.col(column))) > 0).withColumn(number, F.xxhash64(*rows.columns))
        return own.withColumn("__k", F.row_number().over(Window.partitionBy(number).orderBy(*rows.columns))).withColumn(number, F.struct(number, "__k")).drop("__k")

    def parts(rows: DataFrame, column: str, number: str) -> tuple[DataFrame, DataFrame]:
        """Number, n (length) and at (place) of each pair of letters; number, n of each letter."""
        lettered = rows.select(F.col(number).alias("k"), F.explode(F.array(F.split(F.col(column), ""))).alias("c")).withColumn("n", F.size("c"))
        two = F.transform(F.sequence(F.lit(0), F.greatest(F.size("c") - 2, F.lit(0))), lambda i: F.concat(F.get("c", i), F.coalesce(F.get("c", i + 1), F.lit(""))))
        return lettered.filter("n > 1").select("k", "n", F.posexplode(two).alias("at", "g")), lettered.select("k", "n", F.explode(F.array_distinct("c")).alias("g"))

    a, b = side(left, left_text, "__l"), side(right, right_text, "__r")
    (two_a, one_a), (two_b, one_b) = parts(a, left_text, "__l"), parts(b, right_text, "__r")
    rarity = two_a.select("g").unionAll(two_b.select("g")).groupBy("g").agg(F.count("*").alias("c"))
    rare_first = Window.partitionBy("k").orderBy("c", "g", "at")

    def met(short: DataFrame, long: DataFrame, letters: DataFrame, of: DataFrame, strict: bool) -> DataFrame:
        """k of the shorter and of the longer texts that may be alike."""
        ranked = short.filter("n > 3").join(rarity, "g").withColumn("__p", F.row_number().over(rare_first))
        prefix = ranked.filter(F.col("__p") <= F.col("n") - _shared(F.col("n"))).select(F.col("k").alias("s"), F.col("n").alias("sn"), "g").distinct()
        few = letters.filter("n <= 3").select(F.col("k").alias("s"), F.col("n").alias("sn"), "g")
        fits = F.col("sn") < F.col("n") if strict else F.col("sn") <= F.col("n")
        return prefix.join(long.select("k", "n", "g").distinct(), "g").filter(fits).select("s", "k").unionAll(few.join(of, "g").filter(fits).select("s", "k"))

    ab = met(two_a, two_b, one_a, one_b, False).select(F.col("s").alias("__l"), F.col("k").alias("__r"))
    ba = met(two_b, two_a, one_b, one_a, True).select(F.col("k").alias("__l"), F.col("s").alias("__r"))
    scored = ab.unionAll(ba).distinct().join(a, "__l").join(b, "__r").withColumn("score", partial_ratio(F.col(left_text), F.col(right_text)))
    return scored.filter(F.col("score") >= least).drop("__l", "__r")


def fuzzy_columns(left: DataFrame, columns: list[str], right: DataFrame, right_text: str, least: int = 80) -> DataFrame:
    """J18 over several text columns of ``left``, whose name is ``source_column``; blank cells and the word nan don't count."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("source_column"), F.col(c).cast("string").alias("source_text")) for c in columns]))
    rows = left.withColumn("__c", cells).select(*left.columns, "__c.*").filter(~F.lower(F.trim("source_text")).isin("", "nan"))
    return fuzzy_join(rows, right, "source_text", right_text, least)


# Navigation. Chunks are (id, chunk_order, section, text), sentences (id, chunk_order, sentence_order, text).


def words_in_context(sentences: DataFrame, chunks: DataFrame, docs: DataFrame, query: list[str], lexemes: Callable[[Column], Column] = tokens) -> DataFrame:
    """Sentences that hold the words, with their chunk's section and first 200 characters and the document's other columns."""
    hits = holding(sentences, query, lexemes).withColumnRenamed("text", "sentence")
    shown = chunks.select("id", "chunk_order", "section", F.substring("text", 1, 200).alias("chunk_preview"))
    return hits.join(shown, ["id", "chunk_order"]).join(docs, "id")


def chunk_matches(sentences: DataFrame, query: list[str], lexemes: Callable[[Column], Column] = tokens) -> DataFrame:
    """Id, chunk_order, matches (order and text of the sentences that hold the words) and context, the first of them."""
    hits = holding(sentences, query, lexemes)
    ordered = F.array_sort(F.collect_list(F.struct("sentence_order", "text")))
    return hits.groupBy("id", "chunk_order").agg(ordered.alias("matches")).withColumn("context", F.col("matches")[0]["text"])


def highlights(sentences: DataFrame, words: list[str]) -> DataFrame:
    """Id, chunk_order, total_sentences, highlighted: a map of each word that occurs to the sentences that hold it, in order."""
    worded = sentences.withColumn("__w", F.explode(F.array(tokens(F.col("text")))))
    ordered = lambda w: F.array_sort(F.collect_list(F.when(F.array_contains("__w", w.lower()), F.struct("sentence_order", "text"))))
    found = worded.groupBy("id", "chunk_order").agg(F.count("*").alias("total_sentences"), *[ordered(w).alias(f"w{k}") for k, w in enumerate(words)])
    entries = F.array(*[F.struct(F.lit(w).alias("key"), F.col(f"w{k}").alias("value")) for k, w in enumerate(words)])
    return found.select("id", "chunk_order", "total_sentences", F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0)).alias("highlighted"))


def document_statistics(docs: DataFrame, chunks: DataFrame, sentences: DataFrame, phrases: DataFrame, **children: DataFrame) -> DataFrame:
    """Documents with total_chunks, total_sentences, unique_phrases and the numbers of their children (tables with id)."""
    parts = {"total_chunks": (chunks, F.count("*")), "total_sentences": (sentences, F.count("*")), "unique_phrases": (phrases, F.countDistinct("phrase"))}
    parts |= {f"{name}_count": (rows, F.count("*")) for name, rows in children.items()}
    out = docs
    for name, (rows, count) in parts.items():
        out = out.join(rows.groupBy("id").agg(count.alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def navigated(sentences: DataFrame, chunks: DataFrame, docs: DataFrame, query: list[str], reach: int = 10) -> DataFrame:
    """Each hit of R10 with the chunk's matches (R11), the chunk's text and its number of sentences (R12), neighbouring chunks (R13) and the document's numbers (R14), in one plan."""
    hits = words_in_context(sentences, chunks, docs, query)
    targets = hits.select("id", "chunk_order").distinct()
    near = around(chunks, targets, "chunk_order", reach, reach)
    listed = F.array_sort(F.collect_list(F.struct(F.col("chunk_order").alias("order"), "place", "distance", F.substring("text", 1, 300).alias("preview"))))
    adjacent = near.groupBy("id", F.col("target").alias("chunk_order")).agg(listed.alias("adjacent"), F.max(F.when(F.col("distance") == 0, F.col("text"))).alias("chunk_text"))
    counted = sentences.groupBy("id", "chunk_order").agg(F.count("*").alias("chunk_sentences"))
    totals = index_counters(docs, total_chunks=chunks, total_sentences=sentences)
    keys = ["id", "chunk_order"]
    return hits.join(chunk_matches(sentences, query), keys).join(adjacent, keys).join(counted, keys).join(totals, "id")


def document_chunk_statistics(docs: DataFrame, separator: str = r"\n\s*\n", least: int = 2, **children: DataFrame) -> DataFrame:
    """R14 of documents (id, text, others), one row each, whose chunks are their paragraphs: the others, total_chunks, total_sentences, unique_phrases (two words within a chunk's sentences, ``least`` times or more) and the numbers of their children.

    All but the children is counted in the document's row, so no text and no phrase is shuffled. Documents without an id have no chunks.
    """
    others = [c for c in docs.columns if c not in ("id", "text")]
    # Each array in a row of its own, so that it isn't made again for each of its elements.
    cut = F.transform(paragraph_list(F.when(F.col("id").isNotNull(), F.col("text")), separator, sections=()), lambda p: p["text"])
    rows = docs.select("id", *others, F.explode(F.array(F.coalesce(cut, F.array().cast("array<string>")))).alias("ps"))
    sents = F.transform("ps", lambda p: F.transform(F.when(F.length(strip(p)) >= 10, sentence_list(p)), lambda s: s["text"]))
    rows = rows.select("id", *others, F.size("ps").cast("bigint").alias("total_chunks"), F.explode(F.array(F.transform(sents, lambda x: F.coalesce(x, F.array().cast("array<string>"))))).alias("ss"))
    words = F.transform("ss", lambda x: F.flatten(F.transform(x, lambda t: tokens(t))))
    total = F.aggregate("ss", F.lit(0).cast("bigint"), lambda t, x: t + F.size(x))
    rows = rows.select("id", *others, "total_chunks", total.alias("total_sentences"), F.explode(F.array(F.flatten(F.transform(words, lambda w: ngrams(w, 2))))).alias("g"))
    # A phrase counts where the sorted runs hold it for the ``least``-th time.
    rows = rows.select("id", *others, "total_chunks", "total_sentences", F.explode(F.array(F.sort_array("g"))).alias("g"))
    ends = F.filter(F.sequence(F.lit(0), F.size("g")), lambda i: (i >= least) & (i <= F.size("g")) & (F.get("g", i - 1) == F.get("g", i - least)) & ((i == least) | (F.get("g", i - 1) != F.get("g", F.greatest(i - least - 1, F.lit(0))))))
    out = rows.select("id", *others, "total_chunks", "total_sentences", F.size(ends).cast("bigint").alias("unique_phrases"))
    for name, part in children.items():
        out = out.join(part.groupBy("id").agg(F.count("*").alias(f"{name}_count")), "id", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return out


def document_navigated(docs: DataFrame, query: list[str], separator: str = r"\n\s*\n", sections: tuple = SECTIONS, reach: int = 10) -> DataFrame:
    """R15 of documents (id, text, others), one row each, whose chunks are their paragraphs, as ``navigated``: chunks, sentences and matches are made in the document's row and neighbours read from it, so no text is shuffled.

    Documents without an id have no chunks; a query without words matches nothing.
    """
    own = sorted({w.lower() for w in query if w.strip()})
    others = [c for c in docs.columns if c not in ("id", "text")]
    named = docs.filter(F.col("id").isNotNull() & F.lit(bool(own)))
    low = F.lower("text")
    for w in own:  # cheaper than cutting the text
        named = named.filter(low.contains(w))
    rows = with_sections(named, separator, sections).filter(F.size("ps") > 0)
    none = F.array().cast("array<struct<sentence_order:int,text:string>>")
    rows = rows.select("id", *others, "ps", F.explode(F.array(F.transform("ps", lambda p: F.coalesce(F.when(F.length(strip(p["text"])) >= 10, sentence_list(p["text"])), none)))).alias("ss"))
    holds = lambda s: reduce(lambda x, y: x & y, [F.lower(s["text"]).contains(w) for w in own] + [F.array_contains(tokens(s["text"]), w) for w in own], F.lit(True))
    rows = rows.select("id", *others, "ps", "ss", F.explode(F.array(F.transform("ss", lambda x: F.filter(x, holds)))).alias("hs"))
    totals = F.size("ps").cast("bigint").alias("total_chunks"), F.aggregate("ss", F.lit(0).cast("bigint"), lambda t, x: t + F.size(x)).alias("total_sentences")
    found = F.filter(F.transform("hs", lambda h, k: F.when(F.size(h) > 0, k)), lambda k: k.isNotNull())
    rows = rows.select("id", *others, "ps", "ss", "hs", *totals, F.explode(found).alias("k"))
    here = F.get("ps", F.col("k"))
    # Places only grow, so chunks within reach lie within as many elements.
    first = F.greatest(F.col("k") - reach, F.lit(0))
    window = F.transform(F.sequence(first, F.least(F.col("k") + reach, F.size("ps") - 1)), lambda i: F.get("ps", i))
    rows = rows.select("id", *others, F.col("k"), here.alias("c"), F.get("hs", F.col("k")).alias("matches"), F.size(F.get("ss", F.col("k"))).cast("bigint").alias("chunk_sentences"), "total_chunks", "total_sentences", window.alias("near"))
    gap = lambda p: p["pos"] - F.col("c.pos")
    near = F.filter("near", lambda p: F.abs(gap(p)) <= reach)
    listed = F.transform(near, lambda p: F.struct(p["pos"].alias("order"), F.when(gap(p) < 0, "BEFORE").when(gap(p) > 0, "AFTER").otherwise("TARGET").alias("place"), F.abs(gap(p)).alias("distance"), F.substring(p["text"], 1, 300).alias("preview")))
    # Aliases inside a row's structs are lost beside an explode, so that matches are exploded by themselves.
    shown = rows.select("id", F.col("c.pos").alias("chunk_order"), "c.section", F.substring("c.text", 1, 200).alias("chunk_preview"), *others, "matches", listed.alias("adjacent"), F.col("c.text").alias("chunk_text"), "chunk_sentences", "total_chunks", "total_sentences")
    hits = shown.withColumn("s", F.explode("matches"))
    return hits.select("id", "chunk_order", "s.sentence_order", F.col("s.text").alias("sentence"), "section", "chunk_preview", *others, "matches", F.get("matches", F.lit(0))["text"].alias("context"), "adjacent", "chunk_text", "chunk_sentences", "total_chunks", "total_sentences")


def matches_with_neighbours(docs: DataFrame, words: list[str], reach: int = 1) -> DataFrame:
    """Each sentence of documents (id, text, others), one row each, that holds all the words, as target (its number) and sentence, with its words as ``__w``, the document's other columns, and ``near``: the sentences within reach, struct(order, text).

    Neighbours are read from the row's own array, and only for matches, so no text is shuffled. A query
    without words matches nothing.
    """
    own = [w.lower() for w in words if w.strip()]
    rows = with_sentences(docs)
    marked = F.transform("sentences", lambda s, i: F.struct((i + 1).alias("target"), s["text"].alias("sentence")))
    likely = F.filter(marked, lambda m: reduce(lambda x, y: x & y, [F.lower(m["sentence"]).contains(w) for w in own]) if own else F.lit(False))
    others = [c for c in docs.columns if c != "text"]
    hits = rows.select(*others, "sentences", F.inline(likely)).withColumn("__w", F.explode(F.array(tokens(F.col("sentence")))))
    hits = hits.filter(reduce(lambda x, y: x & y, [F.array_contains("__w", w) for w in own]) if own else F.lit(False))
    first = F.greatest(F.col("target") - reach, F.lit(1))
    near = F.slice("sentences", first, F.col("target") + reach - first + 1)
    return hits.withColumn("near", F.transform(near, lambda s, i: F.struct((first + i).alias("order"), s["text"].alias("text")))).drop("sentences")


def found_with_context(docs: DataFrame, words: list[str], reach: int = 1) -> DataFrame:
    """Id, target, sentence, word_count, relevance and context, the sentences within reach in order as JSON, of the sentences of documents (id, text, others) that hold all the words, with the documents' other columns."""
    order = F.col("target")
    hits = matches_with_neighbours(docs, words, reach)
    shown = F.transform("near", lambda x: F.struct(x["order"].alias("order"), x["text"].alias("text"), (x["order"] == order).alias("is_match"), F.abs(x["order"] - order).alias("distance")))
    others = [c for c in docs.columns if c not in ("id", "text")]
    return hits.select("id", "target", "sentence", F.size("__w").alias("word_count"), F.round(rank(F.col("__w"), [x.lower() for x in words]), 6).alias("relevance"), F.to_json(shown).alias("context"), *others)


def case_phrases(phrases: DataFrame, case: object, like: str, k: int = 50) -> DataFrame:
    """The k most frequent phrases of a case that hold a text, whatever the letters' case; equal ones by name."""
    return phrases.filter((F.col("id") == F.lit(case)) & F.lower("phrase").contains(like.lower())).orderBy(F.desc("frequency"), "phrase").limit(k)
