"""Benchmark decontamination with a distributed positional inverted index.

1. The words of the benchmark's windows (13 consecutive words of an item; a shorter item is one
   window) are counted over the whole training corpus.
2. The rarest and second-rarest word of every window are index terms; their training postings
   (term, document, position) are stored.
3. For each window the posting list of its rarest term, shifted by its offset, is intersected with
   the shifted list of the second: what is left are candidate starts.
4. Candidates are compared word by word with their document: exact phrase matches, no hashing. With
   slop > 0 also proximity matches: all distinct words of the window within its length plus slop.

The index is of the corpus' size only for words that benchmark windows need. Benchmark tables are
joined by broadcast only if their rows are counted and below broadcast_rows, else by shuffle. A
document's candidates are gathered per document, which its own length bounds.

Edges: null texts have no words; an item without words is no window; an item id of null matches but
is not listed; equal items are all listed; rows that repeat a doc_id are judged each on its text.
Empty tables work. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import plain_words, stored, text_key

WINDOW, BROADCAST_ROWS = 13, 100_000
_KEY = ["doc_id", "ka", "kb"]


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: (wid, words, items)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wid", F.monotonically_increasing_id())


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, ka, kb, hits) for documents with matches: hits are (start, length, items, kind), exact before proximity. ka, kb: digest of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", text_key(F.col("text")).alias("k"), "text").select("doc_id", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "text")
    windows = stored(item_windows(benchmark, window, item_col, item_text_col), "windows")
    places = windows.select("wid", F.posexplode("words").alias("offset", "term"))
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    vocabulary = stored(places.select("term").distinct(), "vocabulary")
    words = rows.select(F.explode(plain_words(F.col("text"))).alias("term"))
    frequency = stored(words.join(few(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "frequency")
    # a word of a window that the corpus lacks rules the window out
    ranked = places.join(frequency, "term", "left").withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(W.partitionBy("wid"))).where("least > 0")
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("wid").orderBy("n", "offset"))).where("r <= 2")
    ranked = stored(ranked.select("wid", "term", "offset", "r"), "rarest")
    terms = stored(ranked.select("term").distinct(), "terms")
    # the index: postings of the terms that some window needs
    tokens = keyed.select(*_KEY, F.posexplode(plain_words(F.col("text"))).alias("pos", "term"))
    index = stored(tokens.join(few(terms), "term"), "postings")
    first, second = (few(ranked.where(f"r = {r}").select("term", "wid", F.col("offset").alias(f"o{r}"))) for r in (1, 2))
    shifted = lambda by, r: index.join(by, "term").select(*_KEY, "wid", (F.col("pos") - F.col(f"o{r}")).alias(f"s{r}"))
    lone = ranked.groupBy("wid").agg(F.max("r").alias("most")).where("most = 1").select("wid")
    a, b = shifted(first, 1), shifted(second, 2)
    near = (F.col("s1") == F.col("s2")) if slop == 0 else F.abs(F.col("s1") - F.col("s2")).between(0, window + slop)
    met = a.join(b.select(*(F.col(c).alias("_" + c) for c in (*_KEY, "wid")), "s2"), (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("wid") == F.col("_wid")) & near)
    met = met.select(*_KEY, "wid", F.col("s1").alias("s")).unionAll(a.join(few(lone), "wid", "left_semi").select(*_KEY, "wid", F.col("s1").alias("s"))).where("s >= 0" if slop == 0 else "s > -1000000").distinct()
    found = stored(met.join(few(windows), "wid").groupBy(*_KEY).agg(F.collect_list(F.struct("s", "words", "items")).alias("c")), "candidates")
    of = found.select(F.col("doc_id").alias("_doc_id"), F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), "c")
    checked = keyed.join(of, (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select(*_KEY, "c", plain_words(F.col("text")).alias("w"))
    exact = F.transform(
        F.filter("c", lambda x: (x["s"] >= 0) & (F.slice("w", F.greatest(x["s"], F.lit(0)) + 1, F.size(x["words"])) == x["words"])),
        lambda x: F.struct(x["s"].cast("long").alias("start"), F.size(x["words"]).cast("long").alias("length"), x["items"].alias("items"), F.lit("exact").alias("kind")),
    )
    hits = exact
    if slop:
        around = lambda x: F.slice("w", F.greatest(x["s"] - slop, F.lit(0)) + 1, F.size(x["words"]) + 2 * slop)
        loose = F.transform(
            F.filter("c", lambda x: F.size(F.array_except(x["words"], around(x))) == 0),
            lambda x: F.struct(F.greatest(x["s"] - slop, F.lit(0)).cast("long").alias("start"), (F.size(x["words"]) + 2 * slop).cast("long").alias("length"), x["items"].alias("items"), F.lit("proximity").alias("kind")),
        )
        hits = F.concat(exact, loose)
    return checked.select(*_KEY, F.array_sort(hits).alias("hits")).where(F.size("hits") > 0).dropDuplicates(_KEY)


def covered(hits) -> object:
    """Words inside any hit; hits are sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        hits,
        zero,
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), h["start"] + h["length"] - F.greatest(acc["upto"], h["start"]))).alias("n"),
            F.greatest(acc["upto"], h["start"] + h["length"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for each row of docs; exact matches count."""
    found = stored(overlaps(docs, benchmark, window, id_col, text_col).select(*_KEY, covered(F.filter("hits", lambda h: h["kind"] == "exact")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items")), "hits")
    found = found.select(F.col("doc_id").alias("_doc_id"), F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), "n_hit", "items")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("k"), F.size(plain_words(F.col(text_col))).cast("long").alias("n_words"))
    rows = rows.select("doc_id", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "n_words")
    both = rows.join(found, (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    found = overlaps(docs, benchmark, window, id_col, text_col).select(*_KEY, covered(F.col("hits")).alias("n_hit"))
    found = stored(found.select(F.col("doc_id").alias("__id"), F.col("ka").alias("__ka"), F.col("kb").alias("__kb"), F.col("n_hit").alias("__hit")), "hits")
    key = text_key(F.col(text_col))
    bad = (20 * F.col("__hit") >= F.size(plain_words(docs[text_col])))
    return docs.join(found, (key["a"] == F.col("__ka")) & (key["b"] == F.col("__kb")) & docs[id_col].eqNullSafe(F.col("__id")) & bad, "left_anti")
