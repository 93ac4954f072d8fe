"""Fingerprints, SimHash near-duplicates, first-N acceptance and n-gram overlap."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import udfs
from quillspark.operators.spread import salted_join
from quillspark.session import materialize

MASK32 = (1 << 32) - 1


def normal_ascii(text: Column) -> Column:
    """Lower case and single blanks in the JVM; equals the full case folding for texts without special folds."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def first_seen(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row per key, the first in order; by partial aggregation, so a hot key is one row per task."""
    names = df.columns
    return df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r")).select("_r.*")


def exact_groups(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(fingerprint, first_id, copies) of texts that occur more than once."""
    d = F.sha2(normal_ascii(F.col(text)), 256)
    g = df.where(F.col(text).isNotNull()).groupBy(d.alias("fingerprint")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1")


def banded(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, h): the SimHash of each distinct normalised text, under its first id."""
    x = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), udfs.normal(F.col(text)).alias("t"))
    one = x.groupBy("t").agg(F.min("id").alias("id"))
    return one.select("id", udfs.simhash(F.col("t")).alias("h"))


def with_copies(df: DataFrame, id_col: str, text: str, most: int = 3) -> DataFrame:
    """(id_a, id_b): ``near_pairs`` of the distinct normalised texts, and every further document of a text beside the text's first id.

    Digests and hashes of all documents are made once; a text that fills much of the table is one row
    per task where it is grouped and is divided over tasks where its documents meet their first.
    """
    x = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), udfs.normal(F.col(text)).alias("t"))
    x = materialize(x.select("id", F.sha2("t", 256).alias("d"), udfs.simhash(F.col("t")).alias("h")), "digests")
    one = x.groupBy("d", "h").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = one.where("n > 1").select("d", "first_id")
    members = salted_join(x.select("id", "d"), first, "d", F.col("id")).where("id <> first_id").select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))
    return near_pairs(one.select(F.col("first_id").alias("id"), "h"), most).union(members)


def near_pairs(hashes: DataFrame, most: int = 3, parts: int = 5) -> DataFrame:
    """(id_a, id_b) whose hashes differ in at most ``most`` bits.

    The 64 bits are cut into ``parts`` blocks. Two such hashes agree in all but ``most`` of them, so an
    equi join on every choice of ``parts`` - ``most`` blocks finds all pairs; more parts make longer,
    more selective keys (5: ten keys of 25 bits, 6: twenty of 31). A pair is emitted by the first choice
    it agrees on. Equal hashes meet once as a class: members link to their smallest id.
    """
    edges = [64 * k // parts for k in range(parts + 1)]
    choices = list(combinations(range(parts), parts - most))
    cls = hashes.groupBy("h").agg(F.min("id").alias("id"))
    copies = hashes.join(cls.withColumnRenamed("id", "rep"), "h").where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))

    def block(c: Column, k: int) -> Column:
        return F.shiftrightunsigned(c, edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)

    def key(blocks: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for k in blocks:
            out = F.shiftleft(out, edges[k + 1] - edges[k]).bitwiseOR(block(F.col("h"), k))
        return out

    keys = cls.select("id", "h", F.explode(F.array(*[F.struct(F.lit(n).alias("k"), key(c).alias("b")) for n, c in enumerate(choices)])).alias("x")).select("id", "h", "x.k", "x.b")
    a, b = keys.select(*[F.col(c).alias(c + "_a") for c in keys.columns]), keys.select(*[F.col(c).alias(c + "_b") for c in keys.columns])
    p = a.join(b, (F.col("k_a") == F.col("k_b")) & (F.col("b_a") == F.col("b_b")) & (F.col("id_a") < F.col("id_b")))
    apart = F.col("h_a").bitwiseXOR(F.col("h_b"))
    earlier = F.lit(False)
    for n, c in enumerate(choices):
        agree = F.lit(True)
        for k in c:
            agree = agree & (block(apart, k) == 0)
        earlier = earlier | ((F.lit(n) < F.col("k_a")) & agree)
    p = p.where((F.bit_count(apart) <= most) & ~earlier)
    return p.select("id_a", "id_b").union(copies)


def accept_in_order(hashes: DataFrame, most: int = 3) -> DataFrame:
    """The ids accepted when rows come in order of id and a row near an accepted one is turned away."""
    edges = materialize(near_pairs(hashes, most), "edges")
    turned = None
    while not edges.isEmpty():
        roots = edges.select(F.col("id_a").alias("r")).distinct().join(edges.select(F.col("id_b").alias("r")).distinct(), "r", "left_anti")
        out = materialize(edges.join(roots, edges["id_a"] == roots["r"]).select(F.col("id_b").alias("id")).distinct(), "turned")
        turned = out if turned is None else turned.union(out)
        edges = edges.join(out, edges["id_a"] == out["id"], "left_anti")
        edges = materialize(edges.join(out, edges["id_b"] == out["id"], "left_anti"), "edges")
    ids = hashes.select("id")
    return ids if turned is None else ids.join(turned, "id", "left_anti")


def take_accepted(df: DataFrame, id_col: str, text: str, count: int, most: int = 3) -> DataFrame:
    """The first ``count`` acceptable rows in order of id; the count is the feature."""
    good = accept_in_order(banded(df, id_col, text), most).orderBy("id").limit(count)
    return df.join(good.withColumnRenamed("id", id_col), id_col, "left_semi")


def ngram_sets(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(id, g): the distinct n-word runs of each text as an array of 64-bit digests, null for shorter texts.

    Words are a column of their own and no filter rests on them, so that a text is split once: a filter, also the
    one inferred from an inner explode, would be moved below that column and split the text again.
    """
    x = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.filter(F.split(F.lower(F.col(text)), r"(?U)[^\p{L}\p{N}]+", -1), lambda w: w != "").alias("w"))
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1))
    return x.select("id", F.array_distinct(F.transform(starts, lambda k: F.xxhash64(F.slice("w", k, n)))).alias("g"))


def ngram_overlap(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_text: str, n: int = 8) -> DataFrame:
    """Per left row the number of its distinct n-grams and how many the right texts hold; n-grams meet as digests.

    Either side is shuffled once, by digest: there equal (id, n-gram) of the left meet too. The join is by sort and merge,
    never by broadcast: the optimizer's estimate of bytes doesn't count the rows that a text is exploded into.
    The first n-gram of a text carries their number, so that back to the ids go only those rows, the shared n-grams
    and those that several texts of one id hold, which are counted once.
    """
    texts = ngram_sets(left, left_id, left_text, n).select("id", F.size("g").alias("all"), F.posexplode_outer("g").alias("k", "g")).where(F.col("g").isNotNull())
    words = texts.select("id", "g", F.when(F.col("k") == 0, F.col("all")).alias("all")).repartition("g").groupBy("id", "g").agg(F.sum("all").alias("all"), (F.count(F.lit(1)) - 1).alias("again"))
    held = ngram_sets(right.withColumn("__k", F.lit(0)), "__k", right_text, n).select(F.explode_outer("g").alias("g")).where(F.col("g").isNotNull()).distinct()
    hit = words.join(held.withColumn("hit", F.lit(1)).hint("merge"), "g", "left").where(F.col("hit").isNotNull() | F.col("all").isNotNull() | (F.col("again") > 0))
    return hit.groupBy("id").agg(F.sum(F.coalesce("all", F.lit(0)) - F.col("again")).alias("n_grams"), F.count("hit").alias("n_shared")).withColumn("share", F.round(F.col("n_shared") / F.col("n_grams"), 4))


def repeated_sentences(text: Column) -> Column:
    """Whether a sentence of four words or more occurs twice."""
    said = F.filter(F.split(text, r"[.!?\n]+", -1), lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(?U)[\w@./:+%-]+"), F.lit(0))) >= 4)
    said = F.transform(said, normal_ascii)
    return F.size(said) != F.size(F.array_distinct(said))


def without_seen(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows whose key was not written before."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def recency(df: DataFrame, part: str, order: str, most: int) -> DataFrame:
    w = Window.partitionBy(part).orderBy(F.col(order).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
