"""Secret scan with corpus-wide ownership frequency.

Base kinds are found by pattern. A further kind, owned, comes from the corpus:
bare tokens that look like keys are hashed and counted by distinct owners and
by distinct repositories of theirs. A value that several owners hold, or a
great many repositories, is a widely copied example; any other is taken for a
live credential of its owner and adds its spans. Base findings get the same
verdict but always stay. Only hashes of values are written or compared.

Defined cases. A null text is empty and has no spans. Offsets are code points,
end exclusive. Matches of one kind do not overlap (leftmost first); spans of
different kinds may. An owned span that meets a base span is left out. A null
owner is an owner of its own name. Each id is a repository of its own unless
repo_col names a column; rows that repeat an id count once. Work is linear in
a text's length and almost so in its spans, so long texts need no cut. Columns
beyond the named ones are ignored by scan() and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import find_all, materialise, running, text_of

# The base kinds, in the order they are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs that the contract drops as too short cannot hide a longer run of these two, so the length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE_LENGTH = 6
#: A bare token of 20 characters or more with lower case, upper case and digits.
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})[A-Za-z0-9+/_-]++"
BARE_LOOKS = ("[a-z]", "[A-Z]", "[0-9]")
#: From so many distinct owners on, or so many distinct repositories, a value is a widely copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 50
#: Salts of the join by value, as one value may stand in a large part of all rows.
SALTS = 16
SPANS = "array<struct<start:int,kind:int,end:int,hash:string>>"


def _found(rows: DataFrame) -> DataFrame:
    """rows has a column text; base and bare take its place: sorted spans with the hashes of their values."""
    text, own = F.col("text"), [c for c in rows.columns if c != "text"]
    looks = lambda v: v.rlike(BARE_LOOKS[0]) & v.rlike(BARE_LOOKS[1]) & v.rlike(BARE_LOOKS[2])
    kinds = ((ASSIGN, 1, lambda v: F.length(v) >= ASSIGN_VALUE_LENGTH), (ACCESS, 0, lambda v: F.lit(True)), (HEX, 0, lambda v: F.lit(True)), (BARE, 0, looks))
    one = []
    for k, (pattern, group, good) in enumerate(kinds):
        there, none = text.rlike(pattern), F.array()
        # the pieces between matches and the matches alternate
        one += [
            F.when(there, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))).otherwise(none.cast("array<int>")).alias(f"gap{k}"),
            F.when(there, F.transform(find_all(text, pattern), lambda x: F.length(x))).otherwise(none.cast("array<int>")).alias(f"hit{k}"),
            F.when(there, F.transform(find_all(text, pattern, group), lambda v: F.when(good(v), F.sha2(v, 256)))).otherwise(none.cast("array<string>")).alias(f"hash{k}"),
        ]
    lists = [f"{c}{k}" for k in range(4) for c in ("gap", "hit", "hash")]
    step = [F.zip_with(F.slice(f"gap{k}", 1, F.size(f"hit{k}")), F.col(f"hit{k}"), lambda a, b: a + b).alias(f"step{k}") for k in range(4)]
    two = rows.select(*own, *one).select(*own, *lists, *step)
    at = [running(F.col(f"step{k}"), F.lit(0), lambda a, b: a + b).alias(f"at{k}") for k in range(4)]
    three = two.select(*own, *lists, *at)

    def spans(k: int) -> Column:
        def one(x):
            start = x["at"] + x["gap"]
            return F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + x["hit"]).alias("end"), x["hash"].alias("hash"))

        rows_ = F.arrays_zip(F.col(f"at{k}").alias("at"), F.slice(f"gap{k}", 1, F.size(f"hit{k}")).alias("gap"), F.col(f"hit{k}").alias("hit"), F.col(f"hash{k}").alias("hash"))
        return F.transform(F.filter(rows_, lambda x: x["hash"].isNotNull()), one).cast(SPANS)

    return three.select(*own, F.array_sort(F.concat(spans(0), spans(1), spans(2))).alias("base"), spans(3).alias("bare"))


def _apart(df: DataFrame) -> DataFrame:
    """Bare tokens that meet a base span go: those before whose end a base span begins, and ends behind their start."""
    own = [c for c in df.columns if c != "bare"]
    event = lambda key, kind, other, s: F.struct(s[key].alias("key"), F.lit(kind).alias("base"), s[other].alias("other"), s["hash"].alias("hash"))
    # at one place the token's end goes before a base span's start, as spans that touch do not meet
    events = F.array_sort(F.concat(F.transform("base", lambda s: event("start", 1, "end", s)), F.transform("bare", lambda s: event("end", 0, "start", s))))
    both = df.select(*own, "bare", events.alias("events"))
    both = both.select(*own, "bare", "events", F.transform("events", lambda e: F.when(e["base"] == 1, e["other"]).otherwise(0)).alias("ends"))
    far = both.select(*own, "bare", "events", running(F.col("ends"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("far"))
    free = F.filter(F.arrays_zip(F.col("events").alias("e"), F.col("far").alias("far")), lambda x: (x["e"]["base"] == 0) & (x["far"] <= x["e"]["other"]))
    kept = F.transform(free, lambda x: F.struct(x["e"]["other"].alias("start"), F.lit(3).alias("kind"), x["e"]["key"].alias("end"), x["e"]["hash"].alias("hash"))).cast(SPANS)
    return far.select(*own, F.when((F.size("base") > 0) & (F.size("bare") > 0), kept).otherwise(F.col("bare")).alias("bare"))


def ownership(found: DataFrame) -> DataFrame:
    """One row for each candidate value: hash, owners, repositories, copied. Counts are summed before each shuffle."""
    values = F.array_distinct(F.transform(F.concat("base", "bare"), lambda s: s["hash"]))
    each = found.select("owner", "repo", F.explode(values).alias("hash")).groupBy("hash", "owner", "repo").count()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    total = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))
    return total.withColumn("copied", (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, row, text_key, spans, live.

    spans: sorted structs (start, kind, end, hash) of all base kinds and of owned ones; live: the hashes (SHA-256) of
    the values whose verdict is owner-specific. The texts are read once; what follows works on the findings alone.
    """
    text = text_of(text_col)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), named(owner_col).alias("owner"), named(repo_col or id_col).alias("repo"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = materialise(_apart(_found(rows)).withColumn("row", F.monotonically_increasing_id()), "secrets")
    own = materialise(ownership(found).filter(~F.col("copied")).select("hash"), "owned")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    each = found.select("row", F.explode(F.concat("base", "bare")).alias("s")).select("row", "s", F.col("s.hash").alias("hash"), salt.alias("salt"))
    own = own.withColumn("salt", F.explode(F.array([F.lit(k).cast("long") for k in range(SALTS)])))
    live = each.join(own, ["hash", "salt"], "left_semi")
    # a row's spans are bounded by its own text
    by_row = live.groupBy("row").agg(
        F.collect_list(F.when(F.col("s.kind") == 3, F.col("s"))).alias("owned"), F.array_sort(F.collect_set("s.hash")).alias("live")
    )
    some = found.filter(F.size("base") + F.size("bare") > 0).select("doc_id", "row", "text_key", "base").join(by_row, "row", "left")
    none = found.filter(F.size("base") + F.size("bare") == 0)
    empty = F.array().cast("array<string>")
    spans = F.array_sort(F.concat("base", F.coalesce("owned", F.array().cast(SPANS))))
    return some.select("doc_id", "row", "text_key", spans.alias("spans"), F.coalesce("live", empty).alias("live")).unionByName(
        none.select("doc_id", "row", "text_key", F.col("base").alias("spans"), empty.alias("live"))
    )


def redact(docs: DataFrame, mask: str = "<secret>", length_col: str | None = None, **names) -> DataFrame:
    """The input with every span replaced by the mask; rows without spans are unchanged. All columns stay.

    length_col: a column that holds the text's length, put right where the text has changed. Names that begin with
    __secret_ are the operator's own.
    """
    text_col, id_col = names.get("text_col", "text"), names.get("id_col", "doc_id")
    found = scan(docs, **names).filter(F.size("spans") > 0)
    keys = found.select(F.col("doc_id").alias("__secret_id"), F.col("text_key").alias("__secret_at"), F.col("spans").alias("__secret_spans")).dropDuplicates(["__secret_id", "__secret_at"])
    # the search for base findings is repeated here to tell which rows can be left alone; only the others are shuffled
    touched = F.coalesce(F.col(text_col).rlike("|".join(["(?:%s)" % p for p in (ASSIGN, ACCESS, HEX, BARE)])), F.lit(False))
    clean = docs.filter(~touched)
    dirty = docs.filter(touched).withColumn("__secret_key", F.xxhash64(text_of(text_col)))
    hit = dirty.join(keys, F.col(id_col).eqNullSafe(F.col("__secret_id")) & (F.col("__secret_key") == F.col("__secret_at")), "left")
    masked = _masked(hit, F.col(text_col), mask).drop(text_col).withColumnRenamed("__secret_text", text_col)
    if length_col:
        now = F.length(text_col).cast(docs.schema[length_col].dataType)
        masked = masked.withColumn(length_col, F.when(F.col("__secret_spans").isNull(), F.col(length_col)).otherwise(now))
    return clean.unionByName(masked.select(*docs.columns))


def _masked(hit: DataFrame, text: Column, mask: str) -> DataFrame:
    """hit with the column __secret_text: the text with the spans masked, spans that meet under one mask."""
    # four bytes for each character: pieces are then found by their place, without a walk through the text
    wide = F.when(F.col("__secret_spans").isNotNull(), F.encode(text, "UTF-32"))
    one = hit.withColumns({"__secret_wide": wide, "__secret_ends": F.transform("__secret_spans", lambda s: s["end"])})
    two = one.withColumn("__secret_far", running(F.col("__secret_ends"), F.lit(0), lambda a, b: F.greatest(a, b)))

    apart = F.filter(F.arrays_zip(F.col("__secret_spans").alias("s"), F.col("__secret_far").alias("far")), lambda x: x["s"]["start"] >= x["far"])

    def cover(w: Column) -> Column:
        def piece(a: Column, z: Column | None = None) -> Column:
            size = F.lit((1 << 31) - 1) if z is None else 4 * (z - a)
            return F.decode(F.substring(w, 4 * a + 1, size), "UTF-32")

        pieces = F.transform(apart, lambda x: F.concat(piece(x["far"], x["s"]["start"]), F.lit(mask)))
        return F.concat(F.array_join(pieces, ""), piece(F.array_max("__secret_ends")))

    # as a variable of a function the bytes are not copied for every piece, as they are when read from the row
    whole = F.get(F.transform(F.array("__secret_wide"), cover), F.lit(0))
    return two.withColumn("__secret_text", F.when(F.col("__secret_spans").isNull(), text).otherwise(whole))


def _digest(spans: Column) -> Column:
    names = F.array([F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(spark, sf_dir) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def of_kind(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = [of_kind(k) for k in range(3)]
    return found.select("doc_id", *count, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), F.size("live").cast("long").alias("n_live"))
