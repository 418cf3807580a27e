"""References to records that do not exist.

Parent keys are opaque strings. A key is split into a namespace (its text before the at most 16 hexadecimal digits at
its end, and their number) and the integer these digits name, so prefixed, decimal and hyphenated keys are all put in
order by value (decimal ones come in runs of ten); a key that ends in no such digit is a namespace of its own with the integer 0. Within a namespace, integers are cut into blocks of 2**BLOCK_BITS; in a
block the sorted parent integers are compressed into runs of consecutive values, and each distinct reference is
matched as of the run that starts at or before it. A reference beyond that run's end (or before the first run)
names nothing. A block holds at most 2**BLOCK_BITS parents and as many distinct references, whatever the data,
so no task gets an unbounded group; sequential ids shrink by up to 2**BLOCK_BITS, random ones stay one run each.

References are reduced to distinct keys, with map-side combining, before they are matched, so a key that a third
of all rows name costs one row. Rows are joined back only to the keys found at fault; the at most
``HOT_KEYS`` most frequent of these are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.session import cut

BLOCK_BITS = 10
#: Keys that may be salted: a proven bound of the broadcast table. Any other key has at most 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
HOT_ROWS = 10_000
SALTS = 32
#: Characters counted as outer blanks of a key.
BLANKS = " \t\n\r\x0b\x0c\u00a0"
_KEY = r"^(.*?)([0-9a-f]{1,16})$"


def normalise(key: Column) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.btrim(key, F.lit(BLANKS)))


def _split(df: DataFrame, key: str = "target_id") -> DataFrame:
    """Adds ns, pos and block of the normalised ``key``."""
    digits = F.regexp_extract(key, _KEY, 2)
    wide = F.lpad(digits, 16, "0")
    high = F.conv(F.substring(wide, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(wide, 9, 8), 16, 10).cast("bigint")
    pos = F.when(F.length("_digits") > 0, (high - F.lit(1 << 31)) * F.lit(1 << 32) + low).otherwise(F.lit(0))
    return (
        df.withColumn("_digits", digits)
        .withColumn("ns", F.when(F.length("_digits") > 0, F.concat(F.regexp_extract(key, _KEY, 1), F.length("_digits").cast("string"))).otherwise(F.concat(F.lit("\x00"), F.col(key))))
        .withColumn("pos", pos)
        .withColumn("block", F.shiftright("pos", BLOCK_BITS))
        .drop("_digits")
    )


def runs(parents: DataFrame) -> DataFrame:
    """(parent_table, target_id, born) -> runs (parent_table, ns, block, start, end, born array by offset).

    Equal keys count once, with their earliest time of creation. Null and blank keys are no parents."""
    keyed = _split(parents.filter("target_id <> ''"))
    one = keyed.repartition("parent_table", "ns", "block").groupBy("parent_table", "ns", "block", "pos").agg(F.min("born").alias("born"))
    order = Window.partitionBy("parent_table", "ns", "block").orderBy("pos")
    return (
        one.withColumn("run", F.col("pos").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) - F.row_number().over(order))
        .groupBy("parent_table", "ns", "block", "run")
        .agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.array_sort(F.collect_list(F.struct("pos", "born"))).alias("born"))
        .select("parent_table", "ns", "block", "start", "end", F.transform("born", lambda x: x["born"]).alias("born"))
    )


def as_of(run_table: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``present`` and ``born`` (of the parent named) to distinct keys (parent_table, ns, block, pos, ...)."""
    extra = [c for c in keys.columns if c not in ("parent_table", "ns", "block", "pos")]
    left = run_table.select("parent_table", "ns", "block", F.col("start").alias("pos"), F.lit(0).alias("side"), F.struct("start", "end", "born").alias("run"), *[F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in extra])
    right = keys.select("parent_table", "ns", "block", "pos", F.lit(1).alias("side"), F.lit(None).cast(left.schema["run"].dataType).alias("run"), *extra)
    order = Window.partitionBy("parent_table", "ns", "block").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.col("pos") <= F.col("run.end"), F.lit(False))
    return (
        left.unionByName(right)
        .withColumn("run", F.last("run", ignorenulls=True).over(order))
        .filter("side = 1")
        .withColumn("present", hit)
        .withColumn("born", F.when(hit, F.get("run.born", (F.col("pos") - F.col("run.start")).cast("int"))))
        .select("parent_table", "ns", "block", "pos", *extra, "present", "born")
    )


def dangling(references: DataFrame, parents: DataFrame, removed: DataFrame) -> DataFrame:
    """References that name nothing.

    references: ref_table, ref_field, row_id, target (raw), parent_table, seen (time of the reference, or null for
    "time does not matter"), period. parents: parent_table, id (raw), born. removed: parent_table, id (raw).
    Returns ref_table, ref_field, row_id, target_id, kind, period; kind is ``deleted`` if ``removed`` lists the key
    for that table, ``late`` if the parent was born after the reference, else ``missing``. Null or blank
    references are no cases; repeated rows come out once; a null ``born`` or ``seen`` is never late; empty tables
    give no rows (no parents: every reference is dangling). Other columns are ignored."""
    refs = _split(
        references.select("ref_table", "ref_field", "row_id", "parent_table", "seen", "period", normalise(F.col("target")).alias("target_id")).filter("target_id <> ''")
    )
    keys = refs.groupBy("parent_table", "ns", "block", "pos").agg(F.min("seen").alias("first_seen"), F.count("*").alias("n"))
    table = runs(parents.select("parent_table", normalise(F.col("id")).alias("target_id"), "born"))
    gone = _split(removed.select("parent_table", normalise(F.col("id")).alias("target_id")).filter("target_id <> ''")).select("parent_table", "ns", "pos").distinct().withColumn("gone", F.lit(True))
    fault = as_of(table, keys).filter(~F.col("present") | (F.col("born") > F.col("first_seen")))
    fault = fault.join(gone, ["parent_table", "ns", "pos"], "left").select("parent_table", "ns", "pos", "n", "present", "born", F.coalesce("gone", F.lit(False)).alias("gone"))
    fault = cut(fault)
    hot = fault.filter(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "parent_table", "ns", "pos").limit(HOT_KEYS).select("parent_table", "ns", "pos", F.lit(True).alias("hot"))
    hot = F.broadcast(cut(hot))
    on = ["parent_table", "ns", "pos"]
    salted = (
        fault.join(hot, on, "left")
        .withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("n", "hot")
    )
    probes = refs.drop("block").join(hot, on, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hot")
    kind = F.when(F.col("gone") & ~F.col("present"), "deleted").when(~F.col("present"), "missing").when(F.col("born") > F.col("seen"), "late")
    return (
        probes.join(salted, [*on, "salt"])
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("ref_table", "ref_field", "row_id", "target_id", "kind", "period")
        .distinct()
    )


def memory_references(events: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """The four reference fields of the memory tables in the form ``dangling`` takes."""

    def month(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("unknown"))

    def part(df: DataFrame, table: str, field: str, row: str, target: Column, parent: str, seen: Column, period: Column) -> DataFrame:
        return df.select(
            F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(row).alias("row_id"), target.alias("target"), F.lit(parent).alias("parent_table"), seen.cast("timestamp").alias("seen"), period.alias("period")
        )

    never = F.lit(None)
    return reduce(
        DataFrame.unionByName,
        [
            part(events, "timeline_events", "memory_id", "id", F.col("memory_id"), "memory_blocks", F.col("created_at"), month("created_at")),
            part(events, "timeline_events", "fact_id", "id", F.col("fact_id"), "structured_facts", never, month("created_at")),
            part(links, "entity_event_map", "event_id", "entity_id", F.col("event_id"), "timeline_events", never, F.lit("unknown")),
            part(entities, "entities", "memory_ids", "id", F.explode("memory_ids"), "memory_blocks", never, month("first_seen")),
        ],
    )


def memory_parents(blocks: DataFrame, facts: DataFrame, events: DataFrame) -> DataFrame:
    def part(df: DataFrame, table: str, born: Column) -> DataFrame:
        return df.select(F.lit(table).alias("parent_table"), "id", born.cast("timestamp").alias("born"))

    never = F.lit(None)
    return part(blocks, "memory_blocks", F.col("created_at")).unionByName(part(facts, "structured_facts", never)).unionByName(part(events, "timeline_events", never))


def by_period(found: DataFrame) -> DataFrame:
    """Dangling references per table, field, month and kind: distinct (row, target) pairs and distinct rows."""
    one = found.groupBy("ref_table", "ref_field", "period", "kind", "row_id").agg(F.count("*").alias("links"))
    return one.groupBy("ref_table", "ref_field", "period", "kind").agg(F.sum("links").alias("n_links"), F.count("*").alias("n_rows"))
