"""N-gram decontamination against named reference sets.

Grams are 64-bit hashes of their words: no gram's text is built, moved or compared, but
that of grams that a result names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .near import spread


def grams(df: DataFrame, *keep: str, n: int = 8, text: str = "state") -> DataFrame:
    """keep and gram: the hashes of the distinct word n-grams of each row."""
    return spread(df).select(*keep, F.explode(T.gram_hashes(T.words(text), n)).alias("gram"))


def _common(df: DataFrame, share: float, least: int) -> Column:
    """Of grams with df: whether max(least, ceil(share * rows)) rows or more have them."""
    return F.col("df") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * df.agg(F.count("*")).scalar()))


def template_hashes(df: DataFrame, *, n: int = 8, share: float = 0.01, least: int = 5) -> DataFrame:
    """(gram, df): grams in max(least, ceil(share * rows)) rows or more; they say nothing about a source."""
    return grams(df, n=n).groupBy("gram").agg(F.count("*").alias("df")).where(_common(df, share, least))


def template_grams(df: DataFrame, *, n: int = 8, share: float = 0.01, least: int = 5) -> DataFrame:
    """template_hashes with the grams' texts, each read from one row that has it, which the same aggregate names: all grams are made and moved once."""
    one = grams(df, "id", n=n).groupBy("gram").agg(F.count("*").alias("df"), F.min("id").alias("id")).where(_common(df, share, least))
    wanted = one.groupBy("id").agg(F.collect_list(F.struct("gram", "df")).alias("wanted"))
    w = df.select("id", T.words("state").alias("w")).join(wanted, "id")
    place = lambda x: F.array_position(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n))), x["gram"])
    found = w.select(F.explode(F.transform("wanted", lambda x: F.struct(x["gram"].alias("hash"), x["df"].alias("df"), F.when(place(x) > 0, F.array_join(F.slice("w", F.greatest(place(x), F.lit(1)).cast("int"), n), " ")).alias("text")))).alias("x"))
    return found.where("x.text is not null").groupBy("x.hash", "x.df").agg(F.min("x.text").alias("gram")).select("gram", "df")


def ref_grams(refs: DataFrame, *, n: int = 8, share: float = 0.01, least: int = 5) -> DataFrame:
    """(ref, gram) of reference rows without the set's templates."""
    return grams(refs.withColumnRenamed("id", "ref"), "ref", n=n).join(template_hashes(refs, n=n, share=share, least=least), "gram", "left_anti")


def known_grams(refs: DataFrame, *, n: int = 8, share: float = 0.01, least: int = 5) -> DataFrame:
    """(gram) the distinct grams of ref_grams, for where it doesn't matter which reference row has one."""
    return grams(refs, n=n).groupBy("gram").agg(F.count("*").alias("df")).where(~_common(refs, share, least)).select("gram")


def named_ref_grams(sets: dict[str, DataFrame], *, n: int = 8, share: float = 0.01, least: int = 5) -> DataFrame:
    """(set, ref, gram) of several reference sets, each without its own templates."""
    parts = [ref_grams(df, n=n, share=share, least=least).withColumn("set", F.lit(name)) for name, df in sorted(sets.items())]
    return functools.reduce(DataFrame.unionByName, parts)


def gram_hits(df: DataFrame, reference: DataFrame, *, n: int = 8, need: int = 1) -> DataFrame:
    """(id, ref, shared): rows that share `need` or more grams with one reference row; by set, too, where reference has that column.

    The reference grams are the small side; Spark sends them to the tasks where it knows
    their size to be under its limit.
    """
    by = ["set"] if "set" in reference.columns else []
    return grams(df, "id", n=n).join(reference, "gram").groupBy("id", *by, "ref").agg(F.count("*").alias("shared")).where(F.col("shared") >= need)


def hit_ids(df: DataFrame, reference: DataFrame, *, n: int = 8) -> DataFrame:
    """(id): rows that share a gram with reference, as gram_hits has them.

    No pair of a row and a reference row is made: where reference grows with df, as held-out rows
    do, pairs grow with the square of a frequent gram.
    """
    return grams(df, "id", n=n).join(reference, "gram", "left_semi").select("id").distinct()


def loose_hits(df: DataFrame, reference: DataFrame, *, n: int = 8, min_shared: int = 25, min_share: float = 0.2) -> DataFrame:
    """(id, shared, n): rows with min_shared grams of the whole set, or min_share of their own."""
    own = df.select("id", T.gram_hashes(T.words("state"), n).alias("grams"))
    rows = own.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    shared = rows.join(reference.select("gram").distinct(), "gram", "left_semi").groupBy("id", "n").agg(F.count("*").alias("shared"))
    return shared.where((F.col("shared") >= min_shared) | (F.col("shared") >= min_share * F.col("n"))).select("id", "shared", "n")
