"""The history of attributes that change over time, with the period each version held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions.keys import latest_state, norm_key
from mnemosa.operators.chunks import CHUNK, range_chunks
from mnemosa.session import broadcast_if_small

#: Facts in one array that is folded at once; longer histories are folded by pieces and joined.
FOLD = 256

COLUMNS = ["entity_id", "slot", "content", "created_at", "updated_at", "temporal_status", "superseded_at", "superseded_by"]


def slot_key(col: Column | str) -> Column:
    """A slot name without case and separators."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def said(col: Column | str) -> Column:
    """What a text says: without case, punctuation and extra blanks. A null text says nothing."""
    bare = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[\p{P}\p{S}]+", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


_VERSION = "struct<say:string,uuid:string,start:timestamp,last_at:timestamp,ends:timestamp,by:string,hist:timestamp>"

#: Appends a version only upon change; a repeated statement only moves the version's last fact.
_FOLD = f"""aggregate(facts, cast(array() as array<{_VERSION}>), (acc, f) ->
  if(size(acc) > 0 and element_at(acc, -1).say = f.say,
     concat(slice(acc, 1, size(acc) - 1), array(named_struct('say', f.say, 'uuid', element_at(acc, -1).uuid,
       'start', element_at(acc, -1).start, 'last_at', f.at, 'ends', f.ends, 'by', f.by, 'hist', f.hist))),
     concat(acc, array(named_struct('say', f.say, 'uuid', f.uuid, 'start', f.at, 'last_at', f.at,
       'ends', f.ends, 'by', f.by, 'hist', f.hist)))))"""


def slot_facts(facts: DataFrame, slots: DataFrame) -> DataFrame:
    """Facts by state with a known entity and canonical slot, and a creation time."""
    names = slots.select(F.col("name").alias("_name"), slot_key("name").alias("_slot")).filter("_slot <> ''").dropDuplicates(["_slot"])
    state = latest_state(facts, COLUMNS)
    keyed = state.select(
        norm_key("entity_id").alias("entity_id"), slot_key("slot").alias("_slot"), "uuid", F.col("created_at").cast("timestamp").alias("at"),
        said("content").alias("say"), F.when(F.col("superseded_at") >= F.col("created_at"), F.col("superseded_at")).cast("timestamp").alias("ends"),
        norm_key("superseded_by").alias("by"), F.when(norm_key("temporal_status") == "historical", F.col("updated_at")).cast("timestamp").alias("hist"),
    )
    keyed = keyed.filter("entity_id IS NOT NULL AND at IS NOT NULL")
    return keyed.join(broadcast_if_small(names), "_slot").withColumnRenamed("_name", "slot").drop("_slot")


def attribute_history(facts: DataFrame, slots: DataFrame) -> DataFrame:
    """entity_id, slot, uuid, valid_from, valid_to of every version of every attribute.

    Facts of one entity and slot in the order created_at, uuid; facts in a row that say the
    same are one version, named by its first fact. Its last fact ends it: at superseded_at if
    not before created_at, else when the fact in superseded_by was created if that is not
    earlier, else, if historical, at updated_at. valid_to is that end or the next version's
    start, whichever is earlier, and null if there is neither.

    Each run of at most FOLD facts is folded as a sorted array; versions that cross runs are
    joined by a table with one row per run, so no array and no task holds a hot key whole.
    """
    keys, order = ["entity_id", "slot"], ["at", "uuid"]
    chunked = range_chunks(slot_facts(facts, slots), keys, order)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    part = F.floor((F.row_number().over(local) - 1) / FOLD)
    runs = (
        chunked.withColumn("run", F.col(CHUNK).cast("long") * (1 << 32) + part)
        .groupBy(*keys, CHUNK, "run")
        .agg(F.array_sort(F.collect_list(F.struct("at", "uuid", "say", "ends", "by", "hist"))).alias("facts"))
        .select(*keys, "run", F.expr(_FOLD).alias("versions"))
    )
    edges = runs.select(*keys, "run", F.size("versions").alias("m"), F.col("versions")[0].alias("first"), F.element_at("versions", -1).say.alias("last_say"), F.expr("if(size(versions) > 1, versions[1].start, null)").alias("second_start"))
    back = Window.partitionBy(*keys).orderBy("run")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("joins", F.coalesce(F.lag("last_say").over(back) == F.col("first.say"), F.lit(False)))
    edges = edges.withColumn("goes_on", F.coalesce(F.lead("joins").over(back), F.lit(False)))
    # where a version that crosses runs ends, and where the next version begins, seen from the run before
    tail = F.when(F.col("joins") & ((F.col("m") > 1) | ~F.col("goes_on")), F.struct("first.last_at", "first.ends", "first.by", "first.hist"))
    begin = F.when(F.col("joins"), F.col("second_start")).otherwise(F.col("first.start"))
    edges = edges.select(*keys, "run", "joins", "goes_on", F.last(tail, True).over(ahead).alias("tail"), F.last(begin, True).over(ahead).alias("next_start"))
    pieces = runs.join(edges, [*keys, "run"])
    exploded = pieces.select(*keys, "joins", "goes_on", "tail", "next_start", F.expr("size(versions) - 1").alias("top"), "versions", F.posexplode("versions").alias("i", "v")).filter("NOT (joins AND i = 0)")
    crosses = (F.col("i") == F.col("top")) & F.col("goes_on")
    versions = exploded.select(
        *keys, F.col("v.uuid").alias("uuid"), F.col("v.start").alias("valid_from"),
        F.expr("if(i < top, versions[i + 1].start, next_start)").alias("next_start"),
        *[F.when(crosses, F.col(f"tail.{c}")).otherwise(F.col(f"v.{c}")).alias(c) for c in ("last_at", "ends", "by", "hist")],
    )
    named = latest_state(facts, ["created_at"]).select(F.col("uuid").alias("by"), F.col("created_at").cast("timestamp").alias("by_at"))
    named = named.join(versions.filter("ends IS NULL AND by IS NOT NULL").select("by").distinct(), "by", "left_semi")
    ended = versions.join(named, "by", "left")
    end = F.coalesce("ends", F.when(F.col("by_at") >= F.col("last_at"), F.col("by_at")), "hist")
    return ended.select(*keys, "uuid", "valid_from", F.least(end, F.col("next_start")).alias("valid_to"))
