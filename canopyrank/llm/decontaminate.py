"""Benchmark decontamination by a distributed positional inverted index.

One scan of the texts builds the index: postings (text, term, position) of the
benchmark's terms, written to the shared folder and dealt by term. A posting
can take part in a phrase match only if it stands in an unbroken stretch of
benchmark terms as long as the shortest window, so only such stretches are
posted; a table of hashed terms, of bounded size, tells them during the scan.
Equal texts share their postings.

Windows are then looked up in the index alone. The lists are intersected from
the rarest: each window's shortest list gives the places where it could stand,
as offsets between text and item; the words that the window needs around such
a place are joined to their lists at that offset, and stretches that are there
in full are matches. No text is read again, whatever the number of items.

Proximity: an item's rarest terms over the benchmark are posted in every text
that holds enough of them close together; a text is near an item where they
all stand within SLOP words.

Defined cases. A null text has no words. Every row is a document of its own,
also where ids or texts repeat. Item rows may repeat, also under one item_id
(an id counts once); a null item_id is listed as 'null'. An item without words
matches nothing. A very short item weakens the pruning of its index and changes
no result. A text is held by its own row only, so very long ones need no cut.
Columns beyond the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.llm.common import ALNUM_GAP_ANY_CASE, ascii_lower, between, materialise, running, text_of

WINDOW = 13
#: Proximity: so many of an item's rarest distinct terms within so many words.
TERMS, SLOP = 3, 20
#: Rows and bytes of a table that one broadcast may hold; larger tables are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20
#: Slots of the table of hashed terms for each term, and bounds of their number, one byte each.
SLOTS_A_TERM, LEAST_SLOTS, MOST_SLOTS = 64, 1 << 16, 1 << 24
#: Parts of a term's postings, as one term may make up most of them.
POSTING_SALTS = 128
TEXT = ["text_key", "n_words"]


def words(c: Column) -> Column:
    """Words in the case they are written in; ascii_lower makes a term of one, which is cheaper word by word."""
    return between(c, ALNUM_GAP_ANY_CASE)


def is_small(df: DataFrame) -> bool:
    """Whether a written table is within the bounds of a broadcast; its size is that of its rows as JSON."""
    if df.count() > BROADCAST_ROWS:
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if it is small enough."""
    return F.broadcast(df) if is_small(df) else df


def join_spread(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to a written table by a key of which one value may be in most rows.

    A small table is broadcast. Of a larger one every row is copied to each salt, and the rows of a key are dealt
    over the salts, so that no task gets a key's rows whole.
    """
    if is_small(table):
        return rows.join(F.broadcast(table), key, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(POSTING_SALTS).cast("long"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(POSTING_SALTS - 1).cast("long"))))
    return rows.withColumn("__salt", salt).join(copies, [key, "__salt"], how).drop("__salt")


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items with words: item (a hash of id and text), item_id as string, w."""
    return (
        items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"), words(ascii_lower(text_of(text_col))).alias("w"))
        .filter(F.size("w") > 0)
        .dropDuplicates(["item_id", "w"])
        .withColumn("item", F.xxhash64("item_id", "w"))
    )


def rarest_terms(items: DataFrame, terms: int = TERMS) -> DataFrame:
    """The distinct terms of each item that the fewest items hold: item, item_id, k (how many), no, term."""
    each = items.select("item", "item_id", F.explode(F.array_distinct("w")).alias("term"))
    held = each.groupBy("term").agg(F.countDistinct("item_id").alias("n"))
    ranked = each.join(held, "term").groupBy("item", "item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, terms).alias("t"))
    return ranked.select("item", "item_id", F.size("t").alias("k"), F.posexplode("t").alias("no", "x")).select("item", "item_id", "k", "no", F.col("x.term").alias("term"))


def _slot(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def marks(vocabulary: DataFrame) -> tuple[bytearray, int]:
    """A byte for each slot of hashed terms: 2 where a proximity term falls, 1 where another term does, else 0."""
    count = vocabulary.count()
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, SLOTS_A_TERM * count):
        slots *= 2
    table = bytearray(b"0" * slots)
    # at most one row for each slot
    for r in vocabulary.groupBy(_slot(F.col("term"), slots).alias("s")).agg(F.max(F.col("near").cast("int")).alias("near")).toLocalIterator():
        table[r["s"]] = ord("1") + r["near"]
    return table, slots


@dataclass
class Index:
    """docs: doc_id, text_key, n_words, one row for each document. postings and close: text_key, n_words, term, pos."""

    docs: DataFrame
    items: DataFrame
    terms: DataFrame
    postings: DataFrame
    close: DataFrame


def build_index(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, terms: int = TERMS, slop: int = SLOP) -> Index:
    item = materialise(item_words(items, item_col, item_text), "items")
    near = materialise(rarest_terms(item, terms), "terms")
    rare = near.select("term").distinct().withColumn("near", F.lit(True))
    vocabulary = item.select(F.explode("w").alias("term")).distinct().join(rare, "term", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    vocabulary = materialise(vocabulary, "vocabulary")
    need = item.agg(F.min(F.least(F.size("w"), F.lit(window)))).first()[0] or window
    least = near.agg(F.min("k")).first()[0] or terms
    table, slots = marks(vocabulary)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), words(text_of(text_col)).alias("w"))
    mark = F.transform("w", lambda x: F.substring(F.lit(table), _slot(ascii_lower(x), slots) + 1, F.lit(1)).cast("string"))
    one = rows.select("doc_id", "text_key", "w", mark.alias("m"))
    two = one.select("doc_id", "text_key", "w", "m", F.array_join("m", "").alias("line"))
    phrase, group = F.col("line").rlike("[12]{%d}" % need), F.col("line").rlike("2" + "(?:.{0,%d}2){%d}" % (slop, least - 1))
    # where the line of marks turns from terms to other words or back
    pieces = F.when(phrase, F.split("line", "(?<=0)(?=[12])|(?<=[12])(?=0)", -1))
    three = two.select("doc_id", "text_key", "w", "m", pieces.alias("pieces"), group.alias("group"))
    four = three.select("doc_id", "text_key", "w", "m", "group", "pieces", F.transform("pieces", lambda x: F.length(x)).alias("size"))
    five = four.select("doc_id", "text_key", "w", "m", "group", "pieces", "size", running(F.col("size"), F.lit(0), lambda a, b: a + b).alias("at"))
    runs = F.filter(F.arrays_zip("at", "size", "pieces"), lambda x: (x["size"] >= need) & ~x["pieces"].startswith("0"))
    held = F.transform(runs, lambda x: F.struct(x["at"].alias("at"), F.slice("w", x["at"] + 1, x["size"]).alias("w")))
    places = F.filter(F.transform(F.arrays_zip("w", "m"), lambda x, i: F.struct(i.alias("pos"), x["w"].alias("w"), x["m"].alias("m"))), lambda x: x["m"] == "2")
    scanned = materialise(five.select(
        "doc_id", "text_key", F.size("w").cast("long").alias("n_words"), held.alias("runs"),
        F.when(F.col("group"), F.transform(places, lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w")))).alias("places"),
    ), "scanned")

    def posted(rows: DataFrame, terms: DataFrame, tag: str) -> DataFrame:
        """Dealt by term; a frequent term's list is spread by text and position."""
        every = join_spread(rows.select(*TEXT, ascii_lower(F.col("w")).alias("term"), F.col("pos").cast("long").alias("pos")), terms, "term", "left_semi")
        return materialise(every.repartition("term", F.pmod(F.xxhash64("text_key", "pos"), F.lit(POSTING_SALTS))).sortWithinPartitions("term", *TEXT, "pos"), tag)

    texts = lambda c: scanned.filter(F.size(c) > 0).dropDuplicates(TEXT).select(*TEXT, F.explode(c).alias("x"))
    long = texts("runs").select(*TEXT, "x.at", F.posexplode("x.w").alias("i", "w")).withColumn("pos", F.col("at") + F.col("i"))
    close = texts("places").select(*TEXT, "x.pos", "x.w")
    return Index(scanned.select("doc_id", *TEXT), item, near, posted(long, vocabulary.select("term"), "postings"), posted(close, materialise(rare.select("term"), "rare"), "close"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The term with the shortest list of every window: term, item, pos. A window with a term that has no list cannot occur."""
    at = items.select("item", F.posexplode("w").alias("pos", "term")).join(counts, "term", "left")
    lists = at.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", "df", "term"))).alias("t"))
    lists = lists.select("item", "t", F.least(F.size("t"), F.lit(window)).alias("need"))
    of = F.transform(F.sequence(F.lit(0), F.size("t") - F.col("need")), lambda s: F.slice("t", s + 1, F.col("need")))
    best = F.transform(F.filter(of, lambda x: F.forall(x, lambda y: y["df"].isNotNull())), lambda x: F.array_min(F.transform(x, lambda y: F.struct(y["df"], y["pos"], y["term"]))))
    return lists.select("item", F.explode(F.array_distinct(best)).alias("a")).select("item", F.col("a.pos").cast("long").alias("anchor"), F.col("a.term").alias("term"))


def phrase_matches(index: Index, *, window: int = WINDOW) -> DataFrame:
    """Exact phrase matches: text_key, n_words, item_id, from, to (word positions, inclusive); each is one window or several in a row."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    table = materialise(anchors(index.items, counts, window), "anchors")
    # where an item could stand: the offset between its words and the text's
    could = join_spread(index.postings, table, "term").select(*TEXT, "item", (F.col("pos") - F.col("anchor")).alias("offset"), "anchor")
    first = F.greatest(F.col("anchor") - (window - 1), F.lit(0))
    last = F.least(F.col("anchor") + (window - 1), F.size("w") - 1)
    around = F.slice("w", (first + 1).cast("int"), (last - first + 1).cast("int"))
    could = join_spread(could, index.items, "item").select(*TEXT, "item", "item_id", "offset", F.least(F.size("w"), F.lit(window)).alias("need"), first.alias("first"), around.alias("around"))
    needed = could.select(*TEXT, "item", "item_id", "offset", "need", "first", F.posexplode("around").alias("k", "term")).withColumn("i", F.col("first") + F.col("k"))
    needed = needed.select(*TEXT, "item", "item_id", "offset", "need", "i", (F.col("offset") + F.col("i")).alias("pos"), "term").distinct()
    there = needed.join(index.postings, [*TEXT, "term", "pos"], "left_semi")
    # positions in a row share the difference from their rank; an item's places bound the window
    own = [*TEXT, "item", "item_id", "offset", "need"]
    runs = there.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy(*TEXT, "item", "offset").orderBy("i")))
    whole = runs.groupBy(*own, "run").agg(F.min("pos").alias("from"), F.max("pos").alias("to")).filter(F.col("to") - F.col("from") + 1 >= F.col("need"))
    return whole.select(*TEXT, "item_id", "from", "to")


def proximity_matches(index: Index, *, slop: int = SLOP) -> DataFrame:
    """Places where an item's rarest distinct terms all stand within slop words: text_key, n_words, item_id, from (of the first of them)."""
    hits = join_spread(index.close, index.terms, "term")
    seen = W.partitionBy(*TEXT, "item").orderBy("pos").rangeBetween(0, slop - 1)
    most = index.terms.agg(F.max("k")).first()[0] or 1
    found = reduce(lambda a, b: a + b, [F.coalesce(F.max(F.when(F.col("no") == k, 1)).over(seen), F.lit(0)) for k in range(most)])
    return hits.withColumn("seen", found).filter(F.col("seen") == F.col("k")).select(*TEXT, "item_id", F.col("pos").alias("from")).distinct()


def contamination(docs: DataFrame, items: DataFrame, *, share: float = 0.05, window: int = WINDOW, terms: int = TERMS, slop: int = SLOP, **names) -> DataFrame:
    """One row for each document: doc_id, text_key, n_words, n_hit, item_ids and near_ids (sorted strings), contaminated.

    contaminated: at least one word is hit, and hit words are at least the given share of all words. near_ids: items
    whose rarest terms stand close together; they do not count as hits.
    """
    index = build_index(docs, items, window=window, terms=terms, slop=slop, **names)
    # a document's stretches are bounded by its own words and the items they match
    text = phrase_matches(index, window=window).groupBy(*TEXT).agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    zero = F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "runs",
        zero,
        lambda acc, x: F.struct(
            F.greatest(acc["upto"], x["to"]).alias("upto"),
            (acc["n"] + F.greatest(x["to"] - F.greatest(x["from"], acc["upto"] + 1) + 1, F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    hit = text.select(*TEXT, covered.alias("n_hit"), "item_ids")
    near = proximity_matches(index, slop=slop).groupBy(*TEXT).agg(F.array_sort(F.collect_set("item_id")).alias("near_ids"))
    found = small(materialise(hit.join(near, TEXT, "full"), "found"))
    out = index.docs.join(found, TEXT, "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", *TEXT, n_hit.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids"),
        ((n_hit > 0) & (round(1 / share) * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows that are not contaminated; all columns stay. Names that begin with __clean_ are the operator's own."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col, **names).filter("contaminated")
    bad = materialise(found.select(F.col("doc_id").alias("__clean_id"), F.col("text_key").alias("__clean_at")).distinct(), "contaminated")
    if bad.count() <= 10 * BROADCAST_ROWS:  # 16 bytes a row
        bad = F.broadcast(bad)
    marked = docs.withColumn("__clean_key", F.xxhash64(text_of(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__clean_id")) & (F.col("__clean_key") == F.col("__clean_at"))
    return marked.join(bad, same, "left_anti").drop("__clean_key")


def op2(spark, sf_dir) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, items)
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    count = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", "n_hit", count("item_ids").alias("n_items"), ids.alias("items_sha256"), "contaminated", count("near_ids").alias("n_near"))
