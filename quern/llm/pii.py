"""Personal data: exact base kinds, and information-theoretic sanitisation of what reveals them.

Base spans are leftmost, non-overlapping matches of each kind. The patterns here start only where a
match of the stated pattern can start first (after a character outside its class, or where the last
match ended), so that no text, however long its runs, is scanned twice.

What a base span tells is an entity at three levels: its value, the value's class (domain of an email,
half of an address, leading digits of a number) and its kind. All counts are of distinct texts, so
copies count once: n_e of D hold e, n_t hold the term t outside emails, n_et both, anywhere in the
text. P(e) = n_e / D is also what P(e | t) = (n_et + smooth P(e)) / (n_t + smooth) is drawn to where
little is known. A term whose information about e, log2(P(e | t) / P(e)), is at least `disclosure` of
that of e itself, log2(1 / P(e)), is disclosing if it has `support` distinct contexts of e (60 code
points on either side; near copies share them). Where a value has too few texts its class and kind
are what is left. A word of an email's own name needs neither support nor smoothing: a name beside an
address given once is found. Every place of a disclosing term in a text with its entity is a span of
kind "term".

Numbers that a base pattern loses because it runs on into the next one are added by stricter patterns.

sanitised() generalises each span to its kind in brackets and removes disclosing terms.

Edges: null counts as empty; each input row gives one row; rows with equal id and text share
their spans. Of spans that start together the one of the earlier kind comes first. Time is in proportion
to a text's length, however many spans it holds. Other columns, whatever their names, are only handed
on. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import stored, text_key

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kinds in their order. Each pattern finds exactly the places of the stated one, in one pass.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits: whole runs alone
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stricter patterns, for numbers that the base pattern loses because it runs on into the next number.
#: Their matches are added where they meet no base span.
STRICT = {
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
}
AROUND, DISCLOSURE, SUPPORT, SMOOTH, SALTS = 60, 0.8, 3, 5.0, 16
_MARK, _OTHER = "\u0001", "\u0002"
_KEY = ["doc_id", "ka", "kb"]
#: Elements in a block of sums, characters in a block of text.
_BLOCK, _PIECE = 64, 4096
#: Terms are words of letters, at least three.
_NO_TERM, _TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.filter(F.split(value, ""), lambda c: c.rlike("^[0-9]$")))
    terms = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return _digits(value).between(10, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str) -> Column:
    """Gaps and matches, by turns. text has no _MARK."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _blocks(name: str) -> Column:
    """Sums of blocks of an array column."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(name) / _BLOCK).cast("int")), lambda b: _total(F.slice(name, b * _BLOCK + 1, _BLOCK)))


def _running(name: str, blocks: str) -> Column:
    """Sums of all elements before each, from those of whole blocks before."""
    return F.transform(name, lambda _, i: F.get(blocks, F.floor(i / _BLOCK).cast("int")) + _total(F.slice(name, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))


def _before(name: str) -> Column:
    return F.transform(name, lambda _, i: _total(F.slice(name, F.lit(1), i)))


def _placed(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with at_{name}: where each piece of the array column starts; null for arrays of one piece.

    Sums go over blocks and blocks of blocks, so that time stays in proportion to the text. Every sum is
    named twice where it is used: the optimizer would else put a sum named once, inside a lambda, in
    place of its name, to be made again for every element.
    """
    keep = rows.columns
    made = lambda of, c: F.when(F.size(of) > 1, c)
    held = lambda of, c: F.when(F.size(of) > 0, c)
    rows = rows.select("*", *(made(k, F.transform(k, F.length)).alias(f"l_{k}") for k in names))
    rows = rows.select("*", *(held(f"l_{k}", _blocks(f"l_{k}")).alias(f"s_{k}") for k in names))
    rows = rows.select("*", *(held(f"s_{k}", _blocks(f"s_{k}")).alias(f"u_{k}") for k in names))
    rows = rows.select("*", *(held(f"u_{k}", _before(f"u_{k}")).alias(f"v_{k}") for k in names))
    rows = rows.select("*", *(held(f"v_{k}", _running(f"s_{k}", f"v_{k}")).alias(f"b_{k}") for k in names))
    return rows.select(*keep, *(held(f"b_{k}", _running(f"l_{k}", f"b_{k}")).alias(f"at_{k}") for k in names))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = AROUND) -> DataFrame:
    """(doc_id, ka, kb, base, strict): both hold (start, order, end, kind, value, before, after), sorted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("k"), _marked(F.col(text_col)).alias("t"))
    needs = {"email": "@", "phone": "+"}  # cheap tests before the pattern
    patterns = KINDS | {f"strict_{k}": p for k, p in STRICT.items()}
    test = lambda k: F.contains("t", F.lit(needs[k])) if k in needs else F.col("t").rlike("[0-9]")
    rows = rows.select("doc_id", "k", *(F.when(test(k.removeprefix("strict_")), _pieces(F.col("t"), p)).alias(k) for k, p in patterns.items()))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string,before:string,after:string>>")

    def spans(name: str) -> Column:
        kind = name.removeprefix("strict_")
        order = list(KINDS).index(kind)

        def span(value: Column, i: Column) -> Column:
            start = F.get(F.col(f"at_{name}"), i)
            return F.when(
                (i % 2 == 1) & _holds(kind, value),
                F.struct(start.alias("start"), F.lit(order).alias("order"), (start + F.length(value)).alias("end"), F.lit(kind).alias("kind"), value.alias("value"), F.substring(F.get(F.col(name), i - 1), -around, around).alias("before"), F.substring(F.get(F.col(name), i + 1), 1, around).alias("after")),
            )

        return F.when(F.size(name) > 1, F.array_compact(F.transform(name, span))).otherwise(none)

    placed = _placed(rows, list(patterns))
    return placed.select("doc_id", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), F.array_sort(F.concat(*(spans(k) for k in KINDS))).alias("base"), F.array_sort(F.concat(*(spans(f"strict_{k}") for k in STRICT))).alias("strict"))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _NO_TERM)), lambda w: F.length(w) >= 3)


def _marked(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)


def _levels(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    of = F.when(kind == "email", F.lower(F.substring_index(value, "@", -1))).when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "phone", F.substring(digits, 1, 4)).otherwise(F.substring(digits, 1, 6))
    return F.array(F.xxhash64(F.lit("value"), kind, value), F.xxhash64(F.lit("class"), kind, of), F.xxhash64(F.lit("kind"), kind))


def _places_of(rows: DataFrame) -> DataFrame:
    """Of (doc_id, ka, kb, t, told) the places in t of the words told: (doc_id, ka, kb, terms)."""
    rows = _placed(rows.select(*_KEY, "told", _pieces(F.col("t"), _TERM).alias("p")), ["p"])
    span = lambda p, i: F.when((i % 2 == 1) & F.array_contains("told", F.lower(p)), F.struct(F.get("at_p", i).alias("start"), F.lit(len(KINDS)).alias("order"), (F.get("at_p", i) + F.length(p)).alias("end"), F.lit("term").alias("kind")))
    return rows.select(*_KEY, F.when(F.size("p") > 1, F.array_compact(F.transform("p", span))).alias("terms"))


def disclosing_terms(base: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, smooth: float = SMOOTH) -> DataFrame | None:
    """(doc_id, ka, kb, terms) with spans (start, order, end, kind) of disclosing terms; None if there are none. base is stored."""
    text = ["ka", "kb"]
    places = base.select(*text, F.explode("base").alias("s")).select(*text, "s.kind", "s.value", F.xxhash64("s.before", "s.after").alias("c"))
    held = stored(places.select(*text, "c", F.explode(_levels(F.col("kind"), F.col("value"))).alias("e")).groupBy(*text, "e").agg(F.min("c").alias("c")), "entities")
    if held.isEmpty():
        return None
    key = text_key(F.col(text_col))
    texts = docs.groupBy(key["a"].alias("ka"), key["b"].alias("kb")).agg(F.first(text_col).alias("t"))
    texts = texts.join(held.select(*text, F.lit(True).alias("has")).distinct(), text, "left")
    # words of texts with entities by text, those of the others as counts
    outside = F.when(F.contains("t", F.lit("@")), F.regexp_replace("t", KINDS["email"], " ")).otherwise(F.col("t"))
    words = texts.select(*(F.when(F.col("has"), F.col(k)).alias(k) for k in text), F.explode(_terms(F.coalesce(outside, F.lit("")))).alias("w"))
    words = stored(words.groupBy("w", *text).agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = float(base.select(*text).distinct().count())
    chance = F.col("n_e") / total
    least = chance * F.pow(F.lit(2.0), disclosure * F.greatest(F.lit(1.0), -F.log2(chance)))  # of P(e | t); what most texts hold has one bit
    counts = held.groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    entities = held.join(counts, "e")
    near = words.where("ka is not null").select(*text, "w")
    near = stored(near.join(near.select("w").distinct().join(words, "w").groupBy("w").agg(F.sum("n").alias("n_t")), "w"), "near-words")
    given = chance * smooth
    # a term of more texts cannot reach the share, were it with e in all of e's
    pairs = near.where(F.col("n_t") >= support).join(entities.where(F.col("n_e") >= support), text).where((F.least("n_e", "n_t") + given) / (F.col("n_t") + smooth) >= least)
    pairs = pairs.groupBy("e", "w", "n_e", "n_t", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("e", "w", "n_e", "n_t").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("contexts"))
    told = pairs.where((F.col("contexts") >= support) & ((F.col("n_et") + given) / (F.col("n_t") + smooth) >= least)).select("e", "w")
    names = places.where("kind = 'email'").select(*text, _levels(F.col("kind"), F.col("value"))[0].alias("e"), F.explode(_terms(F.substring_index("value", "@", 1))).alias("w")).distinct()
    names = names.join(near, [*text, "w"]).groupBy("e", "w", "n_t").agg(F.count(F.lit(1)).alias("n_et")).join(counts, "e").where(F.col("n_et") / F.col("n_t") >= least).select("e", "w")
    told = stored(told.union(names).distinct(), "told")
    if told.isEmpty():
        return None
    # from the words, which are rare, to the entities of their texts: a kind has many texts and many words
    marks = near.select(*text, "w").join(told, "w").join(held.select(*text, "e"), [*text, "e"]).groupBy(*text).agg(F.collect_set("w").alias("told"))
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.select(F.col(id_col).alias("doc_id"), key["a"].alias("ka"), key["b"].alias("kb"), _marked(F.col(text_col)).alias("t")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return _places_of(rows.join(marks, [*text, "salt"])).dropDuplicates(_KEY)


def _apart(spans: DataFrame, of: Column, others: Column) -> DataFrame:
    """Of rows of spans those that are not `of`, or that overlap none of `others` in their text."""
    order = ("start", "order", "end", "rank")
    before = F.max(F.when(others, F.col("end"))).over(W.partitionBy(*_KEY).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    # what follows, as what precedes in the other direction: Spark adds up a frame that ends unbounded anew for each row
    after = F.min(F.when(others, F.col("start"))).over(W.partitionBy(*_KEY).orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, -1))
    met = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return spans.withColumn("met", of & met).where("not met").drop("met")


def _spans(base: DataFrame, terms: DataFrame | None) -> DataFrame:
    """A row for each span (doc_id, ka, kb, start, order, end, kind) of a text: base ones, strict ones apart from these, terms apart from all. Rows of equal id and text count once."""
    one = base.dropDuplicates(_KEY)
    of = lambda df, name, rank: df.select(*_KEY, F.explode(name).alias("s")).select(*_KEY, "s.start", "s.order", "s.end", "s.kind", F.lit(rank).alias("rank"))
    found = of(one, "base", 0).unionAll(of(one, "strict", 1))
    found = found if terms is None else found.unionAll(of(terms, "terms", 2))
    found = _apart(found, F.col("rank") == 1, F.col("rank") == 0)
    return (found if terms is None else _apart(found, F.col("rank") == 2, F.col("rank") < 2)).drop("rank")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the columns of right (one row a key at most) beside it, by _KEY."""
    other = right.select(*(F.col(c).alias("_" + c) for c in _KEY), *(c for c in right.columns if c not in _KEY))
    on = (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return left.join(other, on, "left").drop(*("_" + c for c in _KEY))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = AROUND, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, ka, kb, base, spans) for each row: spans (start, order, end, kind) are base and term spans, sorted; terms never overlap base spans."""
    base = stored(base_spans(docs, id_col, text_col, around), "base")
    spans = _spans(base, disclosing_terms(base, docs, id_col, text_col, disclosure, support))
    listed = spans.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return _joined(base.select(*_KEY, "base"), listed).select(*_KEY, "base", F.coalesce("spans", none).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with each base span generalised to [kind] and disclosing terms removed.

    Of spans that overlap the first one's kind stands for all. A text is cut in blocks of characters
    first, so that each piece is taken from its block and not counted from the text's start.
    """
    base = stored(base_spans(docs, id_col, text_col), "base")
    spans = _spans(base, disclosing_terms(base, docs, id_col, text_col))
    in_order = W.partitionBy(*_KEY).orderBy("start", "order", "end")
    upto = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce(F.col("start") >= upto, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy(*_KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "order", "end")).alias("kind"))
    cuts = runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cut"))
    cuts = stored(cuts.select(F.col("doc_id").alias("__quern_id"), F.col("ka").alias("__quern_ka"), F.col("kb").alias("__quern_kb"), F.col("cut").alias("__quern_cut")), "cuts")
    key = text_key(F.col(text_col))
    both = docs.join(cuts, (key["a"] == F.col("__quern_ka")) & (key["b"] == F.col("__quern_kb")) & docs[id_col].eqNullSafe(F.col("__quern_id")), "left")
    cut = F.col("__quern_cut")
    blocks = F.when(cut.isNotNull(), F.regexp_extract_all(docs[text_col], F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    both = both.withColumn("__quern_blocks", blocks)
    block = lambda i: F.get("__quern_blocks", i)

    def between(a: Column, b: Column) -> Column:
        """The text from a up to b."""
        i, j = F.floor(a / _PIECE).cast("int"), F.floor(b / _PIECE).cast("int")
        across = F.concat(F.substring(block(i), a % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice("__quern_blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(block(j), F.lit(1), b % _PIECE), F.lit("")))
        return F.when(a >= b, F.lit("")).when(i == j, F.substring(block(i), a % _PIECE + 1, b - a)).otherwise(across)

    name = lambda s: F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    parts = F.transform(cut, lambda s, i: F.concat(between(F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)), s["start"]), name(s)))
    whole = (F.size("__quern_blocks") - 1) * _PIECE + F.length(F.element_at("__quern_blocks", -1))
    new = F.when(cut.isNotNull(), F.concat(F.array_join(parts, ""), between(F.element_at(cut, -1)["end"], whole))).otherwise(docs[text_col])
    return both.select(*(new.alias(c) if c == text_col else docs[c] for c in docs.columns))
