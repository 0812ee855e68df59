"""SpotSigs: signatures of content-word chains that follow common-word anchors.

Every occurrence of a common word is a spot; its signature is the anchor and the next ``chain`` content
words at distance ``distance``. A fingerprint is the sorted set of signature hashes. Fingerprints are
compared by Jaccard; pairs whose set sizes rule out the threshold are pruned, and joins meet only
within neighbouring partitions of the set length. Only DataFrame functions are used.

A text without a complete chain has one signature, its whole sequence of words. Null texts are empty;
empty texts have the signature of no words and equal each other. Equal texts have equal fingerprints.
Extra columns are not read. Equal rows and rows with one id are ordered by the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import range_bucket
from corvane.session import materialise

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = """
the of and to in is that it with for on was by as at from this be are have not or an which
le la les des un une du que qui pour par dans sur est au et en ne pas plus avec
der die das und zu auf sich ist für von ein eine den dem mit nicht im auch über
el los las de y se su por con una para como más del al lo
""".split()
CHAIN = 2
DISTANCE = 1
ROWS_PER_RANGE = 2048


def words_of(text: Column) -> Column:
    """Lower-cased words; the first is empty if the text starts with another character."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def with_signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """``name``: the sorted distinct signature hashes (int) of column ``text``.

    Staged as projections, so that each array is made once: words, then spots and content words,
    then hashes. The j-th spot at word p has p - j content words before it.
    """
    common = lambda w: w.isin(ANCHORS)
    df = df.select("*", words_of(F.col(text)).alias("_w"))
    spots = F.filter(F.transform("_w", lambda w, i: F.when(common(w), i).otherwise(-1)), lambda i: i >= 0)
    content = F.filter("_w", lambda w: ~common(w) & (w != ""))
    df = df.select("*", spots.alias("_s"), content.alias("_c"), F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0).alias("_e"))

    def signature(p: Column, j: Column) -> Column:
        start = p - j - F.col("_e")
        parts = [F.get(F.col("_c"), start + distance * k + distance - 1) for k in range(chain)]
        # A chain that runs past the end is null.
        return F.when(start + distance * chain <= F.size("_c"), F.hash(F.get(F.col("_w"), p), *parts))

    df = df.select("*", F.array_sort(F.array_distinct(F.array_compact(F.transform("_s", signature)))).alias(name))
    whole = F.array(F.hash(F.array_join(F.filter("_w", lambda w: w != ""), " ")))
    return df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(whole)).drop("_w", "_s", "_c", "_e")


def as_text(signatures: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits a signature."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two fingerprints; 0 without intersecting where the sizes rule out ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(small < least * large, F.lit(0.0)).otherwise(exact) if least > 0 else exact


def _to(bucket: str, copy: int) -> Column:
    return F.struct(F.col(bucket).alias("_b"), F.lit(copy).alias("_copy"))


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): every row with the one after it by doc_id, the last with the first.

    Ranges of doc_id are sorted separately; the first rows of a range are also sent to the range
    before, where they stand last. Texts are shuffled once.
    """
    ids = docs.select("doc_id")
    bucket, n = range_bucket(ids, "doc_id", rows_per_range)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", bucket.cast("int").alias("_b"))
    # One row per range.
    starts = ids.select("doc_id", bucket.cast("int").alias("_b")).groupBy("_b").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    )
    starts = sorted((r["_b"], r["first"]["doc_id"]) for r in starts.collect())
    if not starts:
        return with_signatures(rows.drop("_b"), "text", "sigs").select("*", F.col("text").alias("next_text"), F.col("sigs").alias("next_sigs"))
    before = [(b, doc_id, starts[i - 1][0]) for i, (b, doc_id) in enumerate(starts)]
    held = docs.sparkSession.createDataFrame(before, "_b int, _first bigint, _before int")
    rows = rows.join(F.broadcast(held), "_b")
    copies = F.when(
        F.col("doc_id").eqNullSafe(F.col("_first")), F.array(_to("_b", 0), _to("_before", 1))
    ).otherwise(F.array(_to("_b", 0)))
    dealt = rows.select("doc_id", "text", F.explode(copies).alias("_to")).select("doc_id", "text", "_to._b", "_to._copy")
    dealt = with_signatures(dealt.repartition(n, "_b"), "text", "sigs")
    follow = Window.partitionBy("_b").orderBy("_copy", "doc_id", "text")
    out = dealt.select(
        "*", F.lead("text").over(follow).alias("next_text"), F.lead("sigs").over(follow).alias("next_sigs")
    )
    return out.where("_copy = 0").drop("_b", "_copy")


def edited_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, sigs, next_sigs, edited): the last half of each text replaced by the next one's start."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.left("text", F.col("n_chars").cast("int") - half)
    edited = F.concat(kept, F.left("next_text", half))
    return rows.select("doc_id", "n_chars", "sigs", "next_sigs", edited.alias("edited"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(u, v, likeness) between ids that stand for distinct fingerprints, likeness at least ``threshold``.

    Sets are partitioned by length so that sets of one likeness lie in equal or neighbouring
    partitions; within them, sets meet by the rarest part of their signatures (a like pair shares
    one of them) and are verified once. Copies are one representative: its smallest doc_id.
    """
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs")
    sets = materialise(sets.groupBy("sigs").agg(F.min("doc_id").alias("id")), "fingerprints")
    n = F.size("sigs")
    one = sets.select("id", "sigs", n.alias("n"), F.explode("sigs").alias("sig"))
    counts = one.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "sig")
    prefix = one.join(counts, "sig").where("df > 1").withColumn("_r", F.row_number().over(order))
    prefix = prefix.where(F.col("_r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)).cast("int") if threshold < 1 else F.col("n")
    prefix = prefix.select("id", "n", "sig", part.alias("part"))
    left = prefix.select(F.col("id").alias("u"), F.col("n").alias("nu"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("v"), F.col("n").alias("nv"), "sig", "part")
    fits = (F.col("nu") <= F.col("nv")) & (F.col("nu") >= threshold * F.col("nv") - 1e-9) & (F.col("u") != F.col("v"))
    pairs = left.join(right, ["sig", "part"]).where(fits)
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("u"), F.col("sigs").alias("a")), "u")
    pairs = pairs.join(sets.select(F.col("id").alias("v"), F.col("sigs").alias("b")), "v")
    return pairs.select("u", "v", likeness(F.col("a"), F.col("b"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)
