"""Line dedup by a deletion-neighbourhood join, in built-in expressions.

A line's form is lower case with single spaces; blank lines have none.  A line
goes if an earlier line has the same form, or, from ``near_words`` words on, if
an earlier line is one word edit away: a word replaced, left out or added.
Documents count in ascending doc_id, lines from the top.

Forms meet in their deletion variants: the form with one word left out, and the
form itself, as hashed keys.  Forms that leave out a word at the same place and
agree on the rest are one substitution apart, all of them from each other; a
form that equals another's variant is one insertion away.  So each key needs
its earliest member only, never the pairs of a group.  The partner found is
then compared word by word.

One edit leaves the first or the second half of a line alone.  So only forms
that share a half with another form put out variants: the first or last
``n div 2`` words among forms of ``n`` words, and the same of ``n - 1`` where
a form stands for the longer of a pair.

Every table that is joined on a key that many rows may have goes through
``joins.matched``, which sends the few heavy keys to all tasks instead.  The other
large joins are merge joins at every size, so small tables show what large ones
do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import matched
from .session import release, shuffle_partitions, written

NEAR_WORDS = 3  # any two words are one edit apart
PLACE = ["ord", "tie", "line_no"]


def form(line: Column) -> Column:
    """Lower case, words parted by one space.  Most lines are already, and only the others are rewritten."""
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def _lines(docs: DataFrame) -> DataFrame:
    """ord, tie, line_no, norm, n (words), h1 and h2 (which name the form) of all lines with a word."""
    d = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ord"), F.xxhash64("text").alias("tie"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    d = d.select("ord", "tie", "line_no", form(F.col("line")).alias("norm")).where("norm <> ''")
    # Words are one more than spaces.
    n = F.octet_length("norm") - F.octet_length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1
    return d.select("*", n.alias("n"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(11), "norm").alias("h2"))


def _halves() -> list[Column]:
    """Keys of the first and last half, as one of two forms of equal length or the shorter of two, and as the longer."""
    out = []
    for role in (0, 1):
        half = f"cast((n - {role}) div 2 as int)"
        for side, sign in ((1, ""), (2, "-")):
            words = F.expr(f"substring_index(norm, ' ', {sign}{half})")
            out.append(F.when(F.col("n") >= 2 + role, F.xxhash64(F.lit(side), F.col("n") - role, words)))
    return out


def repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """ord, tie, line_no of the lines that go, and ``near``: whether only a near copy is earlier.

    ``ord`` is the doc_id (the largest long for null), ``tie`` a hash of the text.
    A document that is there twice has its rows twice.
    """
    spark = docs.sparkSession
    names = [f"end{k}" for k in range(4)]
    lines = written(_lines(docs).select(*PLACE, "h1", "h2", "n", *[half.alias(name) for name, half in zip(names, _halves(), strict=True)]))
    place = F.struct(*PLACE)
    forms = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in names])
    forms = written(forms.withColumn("end", F.array(*names)).drop(*names))
    release(spark)
    # Forms of which another one shares a half.
    met = forms.where(F.col("n") >= near_words - 1).select("first", F.explode("end").alias("end")).where("end is not null")
    common = written(met.groupBy("end").agg(F.count("*").alias("c")).where("c > 1"))
    likely = written(matched(met, common, ["end"]).select("first.*").distinct())
    release(spark)
    # Their texts, from a second look at the documents: less disk than all lines take.
    texts = _lines(docs).select(*PLACE, "norm", "n").join(likely.hint("merge"), PLACE, "left_semi").dropDuplicates(PLACE)
    # Numbers that rise with the place, so that one long says which of two forms is earlier.
    texts = texts.repartitionByRange(shuffle_partitions(spark), *PLACE).sortWithinPartitions(*PLACE)
    bodies = written(texts.select(F.monotonically_increasing_id().alias("me"), *PLACE, "n", F.split("norm", " ").alias("w")))
    release(spark)
    near = _near_forms(bodies, near_words)
    near = bodies.join(near, "me", "left_semi").select(place.alias("p"))
    gone = forms.select("h1", "h2", F.col("first").alias("p"), F.col("copies").alias("c")).join(near.withColumn("near", F.lit(True)), "p", "left")
    gone = written(gone.where("c > 1 or near").select("h1", "h2", "p", F.coalesce("near", F.lit(False)).alias("near"), "c"))
    out = matched(lines.select(*PLACE, "h1", "h2"), gone, ["h1", "h2"])
    return out.where((F.col("p") != place) | F.col("near")).select(*PLACE, (F.col("p") == place).alias("near"))


def _with_earlier(stride: int) -> Column:
    return F.transform("run", lambda x, i: F.when(i >= stride, x.bitwiseXOR(F.get("run", i - stride))).otherwise(x))


def _variants(bodies: DataFrame) -> DataFrame:
    """me, n, at, key: what is left of a form without its word ``at``; and with ``at`` -1 the form itself.

    A key is the exclusive or of hashes of the words with their places, and the
    number of words.  The words after the one left out move up by one place, so
    neighbouring keys of a form differ in one word at two places, and all keys
    follow from a running exclusive or, taken by doubling strides.
    """
    longest = bodies.agg(F.max("n")).first()[0] or 0
    xor = lambda a, x: a.bitwiseXOR(x)
    zero = F.lit(0).cast("long")
    here = F.transform("w", lambda x, i: F.xxhash64(x, i))
    left = F.transform("w", lambda x, i: F.xxhash64(x, i - 1))
    d = bodies.select("me", "n", here.alias("here"), left.alias("left"))
    d = d.withColumn("run", F.transform("left", lambda x, i: F.when(i > 0, x.bitwiseXOR(F.get("here", i - 1))).otherwise(x)))
    stride = 1
    while stride < longest:
        d = d.withColumn("run", F.when(F.col("n") > stride, _with_earlier(stride)).otherwise(F.col("run")))
        stride *= 2
    d = d.select("me", "n", "run", F.aggregate("left", zero, xor).alias("all"), F.aggregate("here", zero, xor).alias("whole"))
    keys = F.concat(F.transform("run", lambda x: F.xxhash64(F.col("n") - 1, x.bitwiseXOR(F.col("all")))), F.array(F.xxhash64("n", "whole")))
    d = d.select("me", "n", F.posexplode(keys).alias("at", "key"))
    return d.select("me", F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(F.lit(-1)).alias("at"), "key")


def _near_forms(bodies: DataFrame, near_words: int) -> DataFrame:
    """``me`` of the forms of at least ``near_words`` words with an earlier form one word edit away."""
    spark = bodies.sparkSession
    out = written(_variants(bodies))
    dropped, full = out.where("at >= 0"), out.where("at < 0").select("me", "key")
    placed = dropped.withColumn("swap", F.xxhash64("key", "at"))
    earliest = written(placed.groupBy("swap").agg(F.min("me").alias("by"), F.count("*").alias("c")).where("c > 1"))
    swaps = matched(placed, earliest, ["swap"]).where("by < me").select("me", "by", F.col("at").alias("at_me"), F.col("at").alias("at_by"))
    # Variants that are a form; a key is one form's, whatever the number of variants that equal it.
    whole = written(full.groupBy("key").agg(F.min("me").alias("short")).join(dropped.groupBy("key").agg(F.count("*").alias("c")), "key"))
    some = matched(dropped, whole, ["key"])
    adds = some.where("short < me").select("me", F.col("short").alias("by"), F.col("at").alias("at_me"), F.lit(-1).alias("at_by"))
    longer = some.groupBy("short").agg(F.min(F.struct("me", "at")).alias("x")).where("x.me < short")
    cuts = longer.select(F.col("short").alias("me"), F.col("x.me").alias("by"), F.lit(-1).alias("at_me"), F.col("x.at").alias("at_by"))
    pairs = written(swaps.union(adds).union(cuts))
    release(spark)
    mine = bodies.where(F.col("n") >= near_words).select("me", "w")
    # A form may be the partner of very many, so its words go out once for each part of them.
    parts = pairs.withColumn("part", F.pmod(F.xxhash64("me"), F.lit(shuffle_partitions(spark))))
    other = parts.select("by", "part").distinct().join(bodies.select(F.col("me").alias("by"), F.col("w").alias("u")), "by")
    rest = lambda a, at: F.when(F.col(at) < 0, F.col(a)).otherwise(F.concat(F.slice(a, F.lit(1), F.greatest(F.col(at), F.lit(0))), F.slice(a, F.greatest(F.col(at), F.lit(0)) + 2, F.size(a))))
    checked = parts.join(mine, "me").join(other, ["by", "part"]).where(rest("w", "at_me") == rest("u", "at_by"))
    return checked.select("me").distinct()


def _gone_by_document(docs: DataFrame, near_words: int) -> DataFrame:
    """ord, tie and the line numbers that go: ``gone`` all of them, ``near`` those with a near copy only."""
    lines = repeated_lines(docs.select("doc_id", "text"), near_words)
    return lines.groupBy("ord", "tie").agg(F.array_sort(F.collect_set("line_no")).alias("gone"), F.collect_set(F.when(F.col("near"), F.col("line_no"))).alias("near"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """Every row of ``docs`` with its columns, ``text`` without the lines that go.

    Null text stays null, an empty text empty; a text may become empty; blank
    lines stay.  Rows equal in doc_id and text are one document seen twice and
    keep the same lines.  A null doc_id comes last.  Other columns pass through
    whatever their names.
    """
    gone = _gone_by_document(docs, near_words)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ord"), F.xxhash64("text").alias("tie"))
    # A column of its own, used twice, is computed once; inside the function it would be once a line.
    joined = rows.join(gone, ["ord", "tie"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("row.text", "\n")))
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_gone (lines that go), near_gone (those that only have a near copy) and the lines' numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = _gone_by_document(docs, NEAR_WORDS)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ord"), F.xxhash64("text").alias("tie"), count(F.split("text", "\n")).alias("n_lines"))
    listed = F.coalesce(F.array_join("gone", ","), F.lit(""))
    return rows.join(gone, ["ord", "tie"], "left").select("doc_id", "n_lines", count("gone").alias("n_gone"), count("near").alias("near_gone"), listed.alias("lines_gone"))
