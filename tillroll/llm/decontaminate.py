"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Training texts are token lists; the index stores (term, text, position) for the terms of the test
items. A phrase is found by taking the posting list of its rarest term, moving each posting back by the
offset of the term in the phrase, and intersecting the starts with the moved lists of its next rarest
terms and then, within the texts that are left, of all its terms. What remains are exact occurrences.
With a slack the same lists give proximity matches.

Texts are named by the digest of their content, so that copies share postings and rows with the same
or no doc_id can't be mixed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import ascii_lower, digest, release, saved, sha256

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pieces(text: Column) -> Column:
    """Words of a text, with an empty string at an end where the text has no word there."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1)


def words(text: Column) -> Column:
    """A-Z in lower case, then the runs of digits, a-z and characters beyond ASCII. Null has none."""
    return F.filter(_pieces(text), lambda w: w != "")


def word_count(text: Column) -> Column:
    # three passes over the array would split three times, so the ends are looked at in one lambda
    def inner(a: Column) -> Column:
        ends = (F.element_at(a, 1) == "").cast("int") + ((F.size(a) > 1) & (F.element_at(a, -1) == "")).cast("int")
        return F.size(a) - ends

    return F.element_at(F.transform(F.array(_pieces(text)), inner), 1).cast("long")


def tokens(docs: DataFrame) -> DataFrame:
    """content, term and pos of each word of each text."""
    pieces = docs.select(
        digest(F.coalesce("text", F.lit(""))).alias("content"), _pieces(F.col("text")).alias("pieces")
    )
    lead = (F.element_at("pieces", 1) == "").cast("int")
    rows = pieces.select("content", lead.alias("lead"), F.posexplode("pieces").alias("at", "term"))
    return rows.where(F.col("term") != "").select("content", "term", (F.col("at") - F.col("lead")).alias("pos"))


def test_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """item_id, window (digest) and its words, for each window of `size` words of each item.

    An item with fewer words, but not none, is one window. Items without item_id are left out.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")
    )
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    rows = items.where(n > 0).select("item_id", "w", F.explode(starts).alias("i"))
    rows = rows.select("item_id", F.slice("w", F.col("i"), size).alias("words"))
    return rows.select("item_id", digest(F.array_join("words", " ")).alias("window"), "words").distinct()


def window_terms(windows: DataFrame) -> DataFrame:
    """window, its length, and each term with its offset."""
    distinct = windows.select("window", "words").distinct()
    return distinct.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Posting lists (term, content, pos) of the given distinct terms, stored in the shared folder.

    Each task writes the postings of its texts, so nothing is shuffled; copies of a text repeat them.
    """
    return saved(tokens(docs).join(terms, "term", "left_semi"), "postings")


def ranked_terms(terms: DataFrame, index: DataFrame, with_absent: bool = False) -> DataFrame:
    """window, length, term, offset and rank, the rarest term of each window first.

    Windows with a term that never occurs can't occur exactly either, and are gone, unless asked for;
    then such terms come first.
    """
    counts = saved(index.groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    known = terms.join(counts, "term", "left")
    order = Window.partitionBy("window").orderBy("n", "term", "offset")  # null first
    if not with_absent:
        absent = known.where("n IS NULL").select("window").distinct()
        known = known.join(absent, "window", "left_anti")
    ranked = known.withColumn("rank", F.row_number().over(order))
    return saved(ranked.select("window", "length", "term", "offset", "rank"), "ranked-terms")


def _starts(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """Where windows begin by the moved posting lists of the given ones of their terms."""
    moved = index.join(seeds, "term").select(
        "content", "window", "length", (F.col("pos") - F.col("offset")).alias("start")
    )
    return moved.distinct()


def _asked(cands: DataFrame, ranked: DataFrame) -> DataFrame:
    return cands.join(ranked.select("window", "term", "offset"), "window").withColumn(
        "pos", F.col("start") + F.col("offset")
    )


def candidates(index: DataFrame, ranked: DataFrame, n_rare: int = 3) -> DataFrame:
    """content, window, length, start: what is left after intersecting the lists of the rarest terms.

    The intersection is a semi join on text, term and moved position, so postings that copies of a text
    repeat don't multiply.
    """
    left = _starts(index, ranked.where("rank = 1")).where("start >= 0")
    for rank in range(2, n_rare + 1):
        step = ranked.where(F.col("rank") == rank)
        lists = index.join(step.select("term").distinct(), "term", "left_semi")
        found = _asked(left, step).join(lists, ["content", "term", "pos"], "left_semi").select(left.columns)
        left = found.unionByName(left.join(step.select("window"), "window", "left_anti").select(left.columns))
    return saved(left, "candidates")


def _lists_of(docs: DataFrame, terms: DataFrame, cands: DataFrame) -> DataFrame:
    """Posting lists of all window terms, within the texts that have a candidate."""
    some = cands.select("content").distinct()
    keyed = docs.select(digest(F.coalesce("text", F.lit(""))).alias("content"), "text")
    wanted = keyed.join(some, "content", "left_semi").select("text")
    return tokens(wanted).join(terms.select("term").distinct(), "term", "left_semi")


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences of the windows in the texts: content, window, start, length."""
    terms = saved(window_terms(windows), "window-terms")
    index = build_index(docs, terms.select("term").distinct())
    ranked = ranked_terms(terms, index)
    cands = candidates(index, ranked)
    release(docs.sparkSession)
    found = _asked(cands, ranked).join(_lists_of(docs, terms, cands), ["content", "term", "pos"], "left_semi")
    return (
        found.groupBy("content", "window", "start", "length").agg(F.count("*").alias("n")).where("n = length").drop("n")
    )


def proximity_matches(docs: DataFrame, windows: DataFrame, slack: int = 3, min_terms: int = 8) -> DataFrame:
    """Loose occurrences: content, window, start, n_terms.

    These are all starts for which at least `min_terms` terms of the window (all, if it has fewer) lie
    within `slack` words of where they would lie if the window began there; start may lie before the
    text, and a passage mostly has several starts. A word may serve two equal terms of a window. With
    slack 0 and all terms these are the exact matches.

    A match may lack length - min_terms terms, so one of the rarest length - min_terms + 1 is in it.
    Their lists give the seeds. A term that never occurs is one of these and has an empty list.
    """
    terms = saved(window_terms(windows), "window-terms")
    index = build_index(docs, terms.select("term").distinct())
    ranked = ranked_terms(terms, index, with_absent=True)
    needed = F.least(F.lit(min_terms), F.col("length"))
    seeds = ranked.where(F.col("rank") <= F.col("length") - needed + 1)
    cands = saved(_starts(index, seeds), "starts")

    def moved(by: int) -> Column:
        return F.explode(F.sequence(F.col("pos") - by, F.col("pos") + by))

    # A start is within the slack of a seed's, and its terms within the slack of it. Postings are asked for
    # by position, so that the join stays on keys, and once for all starts that share them.
    asked = _asked(cands, ranked).drop("start").withColumn("pos", moved(2 * slack)).distinct()
    found = asked.join(_lists_of(docs, terms, cands), ["content", "term", "pos"], "left_semi")
    # starts beyond the slack of all seeds have too few terms, by the choice of the seeds
    return (
        found.withColumn("pos", moved(slack))
        .groupBy("content", "window", "length", (F.col("pos") - F.col("offset")).alias("start"))
        .agg(F.count_distinct("offset").alias("n_terms"))
        .where(F.col("n_terms") >= needed)
        .select("content", "window", "start", "n_terms")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """`docs` with the columns n_words, n_hit, item_ids (sorted, as strings) and contaminated.

    A word inside any occurrence of a window is hit; a text with a hit is contaminated. A null or empty
    text has no words and is clean, as are all texts if there are no items. Rows that repeat a text or a
    doc_id, or have none, are each judged by their own text. Existing columns with these names are
    replaced.

    A passage that a third of all texts share adds ten rows per text and window, and each text is a key
    of its own. The tables of the benchmark are joined by their size: Spark sends a small one to all
    executors and shuffles by term beyond that.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "contaminated")
    windows = saved(test_windows(benchmark, size), "windows")
    found = saved(phrase_matches(docs.select("text"), windows), "matches")
    release(docs.sparkSession)
    hits = (
        found.select("content", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos"))
        .distinct()
        .groupBy("content")
        .agg(F.count("*").alias("_n_hit"))
    )
    items = (
        found.select("content", "window")
        .distinct()
        .join(windows.select("window", "item_id"), "window")
        .groupBy("content")
        .agg(F.array_sort(F.collect_set("item_id")).alias("_item_ids"))
    )
    # stored, so that the join with a text that very many rows share can be split
    per_text = saved(hits.join(items, "content").withColumnRenamed("content", "_hit_content"), "hits")
    # counted before the join, so that a caller who doesn't want the texts doesn't shuffle them
    counted = docs.withColumns(
        {"_content": digest(F.coalesce("text", F.lit(""))), "_n_words": word_count(F.col("text"))}
    )
    joined = counted.join(per_text, F.col("_content") == F.col("_hit_content"), "left")
    n_hit = F.coalesce("_n_hit", F.lit(0)).cast("long")
    return joined.select(
        *[F.col(c) for c in docs.columns],
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("_item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (n_hit > 0).alias("contaminated"),
    )


def items_digest(ids: Column) -> Column:
    return sha256(F.array_join(ids, ","))
