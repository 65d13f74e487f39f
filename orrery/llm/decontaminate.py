"""Benchmark decontamination with DataFrame functions only.

A window is ``n`` neighbouring words of a benchmark item; an item with fewer words, but not none,
is one window. Two broadcast hash sets (behind a check of their size; beyond it the same joins are
left to shuffle) are scanned against: the longest word of every window, and where that word is
met, the exact word sequences of the windows around it, so every hit is verified against the words
themselves. Documents are read once; only hits and one row per document are grouped.

Defined results: null texts and texts without words have no hits; null ids are kept; repeated
rows are each returned; a null item id hits, but is not listed; without items nothing is hit. Extra
columns may have any name; the report has its own, and kept rows come back with theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.columns import unused

WINDOW = 10
BROADCAST_WINDOWS = 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: a word of the text as it stands, with what separates it from the word before
_PIECES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    pieces = F.split(F.translate(text, _UPPER, _UPPER.lower()), BETWEEN)
    return F.coalesce(F.filter(pieces, lambda word: word != ""), F.array().cast("array<string>"))


def _sequences(words: Column, length: int) -> Column:
    """Every run of ``length`` words, joined by spaces, in order."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - (length - 1)), lambda i: F.array_join(F.slice(words, i, length), " "))
    return F.when(F.size(words) >= length, runs).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, n: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(window, length, items): each distinct window with the ids of the items that have it."""
    words = benchmark.select(F.col(id_column).cast("string").alias("item"), normal_words(F.col(text_column)).alias("words"))
    whole = F.when(F.size("words") >= n, _sequences(F.col("words"), n)).when(
        F.size("words") > 0, F.array(F.array_join("words", " ")))
    runs = words.select("item", F.least(F.size("words"), F.lit(n)).alias("length"), F.explode(whole).alias("window"))
    return runs.groupBy("window", "length").agg(F.collect_set("item").alias("items"))


def _around_anchors(words: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, text_key, at, n_words, run, window): word runs that have a window's longest word in its place.

    One row per document, at 0, is kept through the joins. ``windows`` is small enough to broadcast.
    """
    parts = windows.select("length", F.split("window", " ").alias("words"))
    lengths = F.transform("words", lambda word: F.length(word))
    place = F.array_position(lengths, F.array_max(lengths)).cast("int")
    anchors = parts.select(F.try_element_at("words", place).alias("word"), F.struct(
        place.alias("place"), F.col("length").alias("length")).alias("spot"))
    anchors = anchors.groupBy("word").agg(F.collect_set("spot").alias("spots"))
    each = words.select("id", "text_key", "words", F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("at", "word"))
    met = each.join(F.broadcast(anchors), "word", "left").filter((F.col("at") == 0) | F.col("spots").isNotNull())
    runs = F.transform("spots", lambda spot: F.struct(
        (F.col("at") - spot["place"] + 1).alias("start"), spot["length"].alias("length")))
    fitting = F.filter(runs, lambda run: (run["start"] > 0) & (run["start"] + run["length"] - 1 <= F.size("words")))
    tried = met.select("id", "text_key", "at", "words", F.size("words").alias("n_words"), F.explode_outer(fitting).alias("run"))
    return tried.select("id", "text_key", "at", "n_words", "run", F.array_join(
        F.slice("words", F.col("run.start"), F.col("run.length")), " ").alias("window"))


def _all_runs(words: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows for every run of the windows' lengths, for window sets beyond the broadcast bound."""
    # at most n lengths
    lengths = [row.length for row in windows.select("length").distinct().collect()]
    mark = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window")))

    def of(length: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("words") - (length - 1)), lambda i: F.struct(
            i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice("words", i, length), " ").alias("window")))
        return F.when(F.size("words") >= length, every).otherwise(F.filter(mark, lambda _: F.lit(False)))

    each = words.select("id", "text_key", F.size("words").alias("n_words"), F.explode(F.concat(mark, *map(of, lengths))).alias("run"))
    return each.select("id", "text_key", F.col("run.start").alias("at"), "n_words", "run", F.col("run.window").alias("window"))


def find(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, text_key, n_words, hits, copies): one row per distinct (id, text).

    ``hits`` holds the start (from 1), length and item ids of every occurring window; ``copies`` is
    the number of equal rows and ``text_key`` tells texts of one id apart.
    """
    windows = item_windows(benchmark, n)
    words = documents.select(
        F.col(id_column).alias("id"), F.struct(F.xxhash64(text_column), F.length(text_column)).alias("text_key"),
        normal_words(F.col(text_column)).alias("words"))
    if windows.count() <= broadcast_windows:
        texts = _around_anchors(words, windows)
        known = F.broadcast(windows)  # under the size check
    else:
        texts = _all_runs(words, windows)
        known = windows
    found = texts.join(known.select("window", "items"), "window", "left").filter(
        (F.col("at") == 0) | F.col("items").isNotNull())
    hit = F.when(F.col("items").isNotNull(), F.struct(
        F.col("run.start").alias("start"), F.col("run.length").alias("length"), F.col("items").alias("items")))
    return found.groupBy("id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.collect_set(hit).alias("hits"), F.count_if(F.col("at") == 0).alias("copies"))


def hit_positions(hits: Column) -> Column:
    """The distinct word positions (from 1) inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))


def hit_items(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))


def report(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """One row per document row: (id, n_words, n_hit, item_ids, contaminated)."""
    found = find(documents, benchmark, n, id_column, text_column)
    rows = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))))
    return rows.select(
        F.col("id").alias(id_column), F.col("n_words").cast("long").alias("n_words"),
        F.size(hit_positions(F.col("hits"))).cast("long").alias("n_hit"), hit_items(F.col("hits")).alias("item_ids"),
        (F.size("hits") > 0).alias("contaminated"))


def _keyed(documents: DataFrame, found: DataFrame, id_column: str, text_column: str, how: str, hits: str) -> DataFrame:
    """``documents`` joined with the ``hits`` of their id and text."""
    hit_id, hit_key = unused(documents, "_hit_id", "_hit_key")
    right = found.select(F.col("id").alias(hit_id), F.col("text_key").alias(hit_key), F.col("hits").alias(hits))
    key = F.struct(F.xxhash64(documents[text_column]), F.length(documents[text_column]))
    same = documents[id_column].eqNullSafe(right[hit_id]) & (key.cast("struct<col1:bigint,col2:int>").eqNullSafe(right[hit_key]))
    return documents.join(right, same, how)


def remove_documents(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The rows without any hit, all columns as they were."""
    found = find(documents, benchmark, n, id_column, text_column).filter(F.size("hits") > 0)
    return _keyed(documents, found, id_column, text_column, "left_anti", *unused(documents, "_hits"))


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """All rows; where windows occur, their words (and the separators before each) are cut out of the text."""
    found = find(documents, benchmark, n, id_column, text_column).filter(F.size("hits") > 0)
    pieces = F.regexp_extract_all(F.col(text_column), F.lit(_PIECES), F.lit(0))
    # hits sort right before the word at their place; the array of one keeps the list from being made anew per word
    hits, words = unused(documents, "_hits", "_list")
    marks = F.transform(hit_positions(F.col(hits)), lambda p: F.struct(p.alias("p"), F.lit(0).alias("word"), F.lit("").alias("t")))
    own = F.transform(pieces, lambda t, i: F.struct((i + 1).alias("p"), F.lit(1).alias("word"), t.alias("t")))
    joined = _keyed(documents, found, id_column, text_column, "left", hits).withColumn(
        words, F.explode(F.array(F.when(F.col(hits).isNotNull(), F.sort_array(F.concat(marks, own))))))
    before = F.concat(F.array(F.lit(0)), F.transform(words, lambda e: F.when(e["word"] == 0, e["p"]).otherwise(0)))
    kept = F.zip_with(words, F.slice(before, 1, F.size(words)), lambda e, hit: F.when(e["p"] != hit, e["t"]))
    rest = F.array_join(F.filter(kept, lambda t: t.isNotNull()), "")
    return joined.withColumn(text_column, F.when(F.col(hits).isNull(), F.col(text_column)).otherwise(rest)).select(
        *documents.columns)
