"""Row drops: the first reason that holds counts, then exact and near duplicates keep their first row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import SEP
from . import decontam, keepfirst, near
from .tables import written


def reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def token_pieces(text: Column | str) -> Column:
    """The default token counter: runs of letters and digits, and each other sign."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def too_long(text: Column | str, limit: int, count: Column | None = None) -> Column:
    """More than limit tokens; a token has one byte at least, so texts of up to limit bytes are never counted."""
    return F.when(F.octet_length(text) <= limit, F.lit(False)).otherwise((token_pieces(text) if count is None else count) > limit)


def too_short(text: str, least: int) -> Column:
    """Fewer than least letters, digits and _; where a text's begin has as many, the rest isn't read."""
    bare = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))
    return F.when(bare(F.substring(text, 1, 10 * least)) >= least, F.lit(False)).otherwise(bare(F.col(text)) < least)


def reasons(train: DataFrame, held: DataFrame, *, min_chars: int = 40, need: int = 1) -> DataFrame:
    """train with key and reason: equals_heldout, shares_8gram, too_short, damaged, or null."""
    train = near.spread(train)
    # what texts tell is told before the joins, which move no text that the caller doesn't ask for
    rows = train.withColumn("key", F.md5(T.norm_key("state"))).withColumn("__short", too_short("state", min_chars)).withColumn("__damaged", T.damaged("state"))
    equal = held.select(F.md5(T.norm_key("state")).alias("key")).distinct().withColumn("equal", F.lit(True))
    hit = decontam.hit_ids(train, decontam.known_grams(held)) if need <= 1 else decontam.gram_hits(train, decontam.ref_grams(held), need=need).select("id").distinct()
    flagged = rows.join(equal, "key", "left").join(hit.withColumn("hit", F.lit(True)), "id", "left")
    return flagged.withColumn("reason", reason([("equals_heldout", F.col("equal").isNotNull()), ("shares_8gram", F.col("hit").isNotNull()), ("too_short", F.col("__short")), ("damaged", F.col("__damaged"))])).drop("equal", "hit", "__short", "__damaged")


def without_duplicates(rows: DataFrame) -> DataFrame:
    """rows with key and reason; among rows without a reason all but a key's first are `duplicate`."""
    first = rows.where("reason is null").groupBy("key").agg(F.min("ordinal").alias("first"))
    again = F.col("reason").isNull() & (F.col("ordinal") > F.col("first"))
    return rows.join(first, "key", "left").withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason"))).drop("first")


def clean(train: DataFrame, held: DataFrame, **options: int) -> DataFrame:
    """train with key and reason; among rows without one all but a key's first are `duplicate`."""
    return without_duplicates(reasons(train, held, **options))


def own_frames(rows: DataFrame, refs: DataFrame, *, own_share: float = 0.0005, own_least: int = 20, shared: DataFrame | None = None) -> DataFrame:
    """(source, gram): grams of refs in max(own_least, own_share * rows) rows or more of a source.  shared: the rows' grams that refs have, where they are known."""
    limits = rows.groupBy("source").agg(F.greatest(F.lit(own_least), F.ceil(F.lit(own_share) * F.count("*"))).alias("limit"))
    told = decontam.grams(rows, "id", "source").join(refs.select("gram").distinct(), "gram") if shared is None else shared
    return told.select("id", "source", "gram").distinct().groupBy("source", "gram").agg(F.count("*").alias("n")).join(limits, "source").where("n >= limit").select("source", "gram")


def set_hits(train: DataFrame, refs: DataFrame, *, frames: DataFrame | None = None, own: DataFrame | None = None, own_share: float = 0.0005, own_least: int = 20, need: int = 1) -> DataFrame:
    """(id, set): the first reference set, by name, of which one row shares `need` grams or more with a row of train.

    A gram in max(own_least, own_share * rows) rows or more of a row's own source is that
    source's frame, and no hit.  refs: set, ref, gram, as of decontam.named_ref_grams.
    frames: the rows that tell frames, if not train (all of a source, where train is a batch of it).
    own: what own_frames() found in such rows, so that batches don't read them again.
    """
    shared = written(decontam.grams(train, "id", "source").join(refs, "gram"), "shared")
    if own is None:
        own = own_frames(train if frames is None else frames, refs, own_share=own_share, own_least=own_least, shared=shared if frames is None else None)
    common = own.select(F.col("source").alias("__s"), F.col("gram").alias("__g"))
    left = shared.join(common, shared["source"].eqNullSafe(F.col("__s")) & (F.col("gram") == F.col("__g")), "left_anti")
    return left.groupBy("id", "set", "ref").agg(F.count("*").alias("n")).where(F.col("n") >= need).groupBy("id").agg(F.min("set").alias("set"))


def clean_near(
    train: DataFrame, held: DataFrame, *, limit: int = 4096, threshold: float = 0.8, question: str | None = None, min_chars: int = 40, need: int = 1,
    refs: DataFrame | None = None, index: keepfirst.KeptIndex | None = None, within: bool = True, count: Column | None = None, frames: DataFrame | None = None, own: DataFrame | None = None,
) -> DataFrame:
    """The whole chain, train with key and reason.  The first that holds counts:

    equals_heldout                     equal to a held-out row, question included
    train_near_heldout                 near a held-out row of the same question
    train_state_in_heldout             the state alone is a held-out row's, whatever it asks
    train_state_near_heldout           the state is near one's
    shares_8gram, prompt_too_long, too_short, damaged
    decontam_8gram:<set>               a gram of a reference set (see set_hits), where refs are given
    duplicate                          state and question equal a kept earlier row's
    train_near_duplicate               near a kept earlier row of the same question
    train_cross_source_state           equal or near to a kept earlier row of another source, whatever it asks

    question: a column of both frames, e.g. a hash of the instructions.  Without one, held-out
    rows ask what all do, and near rows of one source ask the same.  Earlier is by ordinal, then id; only rows that stay block others
    (see keepfirst).  index: rows kept of earlier batches, which come before all; the kept
    rows of this batch are added to it.  within=False compares with the index alone.
    count: the tokens of a prompt, if not token_pieces().  frames, own: see set_hits.
    """
    ask = F.col(question).cast("string") if question else F.lit(None).cast("string")
    asked = lambda df: df.withColumn("__q", F.coalesce(F.concat(F.lit("="), ask), F.lit("")))
    train, held = asked(train), asked(held)
    mine = written(near.signatures(train, "state", "id", "__q"), "signatures")
    theirs = written(near.signatures(held, "state", "id", "__q"), "signatures")
    close = near.near_hits(mine, theirs, threshold=threshold, key="__q").select("id").distinct().withColumn("close", F.lit(True))
    rows = reasons(train, held, min_chars=min_chars, need=need).withColumnRenamed("reason", "old")
    equal = held.select(F.md5(T.norm_key("state")).alias("key"), "__q").distinct().withColumn("equal", F.lit(True))
    rows = rows.join(close, "id", "left").join(equal, ["key", "__q"], "left")
    if question:
        state = near.near_hits(mine, theirs, threshold=threshold).select("id").distinct().withColumn("state_close", F.lit(True))
        rows = rows.join(state, "id", "left")
    else:
        rows = rows.withColumn("state_close", F.lit(None).cast("boolean"))
    rows = rows.join(set_hits(train, refs, frames=frames, own=own, need=need), "id", "left") if refs is not None else rows.withColumn("set", F.lit(None).cast("string"))
    old = F.col("old")
    chained = reason([
        ("equals_heldout", F.col("equal").isNotNull()), ("train_near_heldout", F.col("close").isNotNull()),
        ("train_state_in_heldout", old == "equals_heldout"), ("train_state_near_heldout", F.col("state_close").isNotNull()),
        ("shares_8gram", old == "shares_8gram"), ("prompt_too_long", too_long("state", limit, count)), ("too_short", old == "too_short"), ("damaged", old == "damaged"),
    ])
    rows = rows.withColumn("reason", F.coalesce(chained, F.concat(F.lit("decontam_8gram:"), F.col("set")))).drop("old", "close", "equal", "state_close", "set")
    rows = written(rows.withColumn("ord", F.struct(F.col("ordinal").cast("long").alias("ord"), "id")).withColumn("exact", F.md5(F.concat_ws(SEP, "key", "__q"))), "reasons")
    open_rows = rows.where("reason is null").select("id", F.col("ordinal").alias("ord"), F.col("__q" if question else "source").alias("question"), F.col("source").alias("origin"))
    found = written(keepfirst.decide(open_rows.join(mine.select("id", "sig"), "id", "left"), index=index, threshold=threshold, within=within), "near")
    rows = rows.join(found, "id", "left")
    stays = rows.where("reason is null and near is null").groupBy("exact").agg(F.min("ord").alias("first"))
    rows = rows.join(stays, "exact", "left")
    if index is not None:
        seen = index.table("rows").select("exact").distinct().withColumn("seen", F.lit(True))
        rows = rows.join(seen, "exact", "left")
    again = F.coalesce(F.col("ord") > F.col("first"), F.lit(False)) if index is None else F.coalesce(F.col("ord") > F.col("first"), F.lit(False)) | F.col("seen").isNotNull()
    late = reason([("duplicate", again), ("train_near_duplicate", F.col("near") == "same"), ("train_cross_source_state", F.col("near") == "cross")])
    out = rows.withColumn("reason", F.coalesce("reason", late))
    if index is not None:
        out = written(out, "decided")
        kept = out.where("reason is null").join(mine.select("id", "sig"), "id", "left")
        text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
        index.append(kept.select(near.signature_id(F.col("sig")).alias("sid"), "sig", text("__q" if question else "source").alias("question"), text("source").alias("origin"), "exact"))
    return out.drop("__q", "ord", "exact", "near", "first", "seen")


def drop_counts(cleaned: DataFrame, *groups: str) -> DataFrame:
    return cleaned.groupBy(*groups, F.coalesce("reason", F.lit("kept")).alias("verdict")).agg(F.count("*").alias("n"))
