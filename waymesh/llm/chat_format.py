"""Operator 10: tool-call linking and canonical JSON, in DataFrame operations only.

Calls and results are hash-joined by identifier.  Arguments are parsed as
VARIANT, so objects come out compact and with sorted keys, and are checked
against their tool's schema: missing required parameters, unknown ones, and
wrong types.  Calls are then put in topological order of what they depend on.
Where every dependency in a conversation is on an earlier turn, its turns are
the order.  In the others a call's place is its level: one more than the
greatest level of what it depends on.  Conversations of at most ``FOLDED`` calls
get their levels inside their row.  In larger ones calls with one open
dependency are pointed past each other by doubling, so a chain of n calls takes
log n jobs, then all calls whose dependencies have levels get theirs, and so on;
a job a level is needed only where levels have calls with several dependencies.
Calls in a cycle, or behind one, have no level and come last.

Inputs: ``calls`` (conv_id, turn, call_id, name, arguments as JSON text,
depends_on array of identifiers), ``results`` (conv_id, turn, call_id, content),
``schemas`` (name, param, type, required) with types as VARIANT names them
(STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY, OBJECT; any of BIGINT, DECIMAL, DOUBLE
passes as DOUBLE).  Schemas of at most ``SMALL_BYTES`` (measured) are broadcast,
larger ones meet the calls by salted names.  One tool's parameters and one
call's arguments fit a row, as does each text; nothing else is gathered in one.

Defined cases: a null identifier links with nothing (status ``unidentified``);
a call without result is ``pending``, a result without call ``orphan``; of
several results with one identifier the first by turn and content counts, and
their number is kept; results with a null identifier are orphans row by row;
repeated calls are rows of their own, and what depends on their identifier
depends on the first of them by turn; dependencies on unknown identifiers or on
the call's own are counted as ``dangling`` and don't order; arguments that are
null or no JSON object (or repeat a key) are an error; a tool without schema, or
a null tool, is an error, and with an empty ``schemas`` so is each; a null turn
comes first among its level's, and last where turns are the order; of equal rows
one gets the lower number; empty tables give no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, scratch_path, written

#: Calls of a conversation whose levels are found inside a row.
FOLDED = 256
#: Bytes of schemas that are broadcast.
SMALL_BYTES = 4 << 20
_SALTS = 32
_NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL")
_LAST = 1 << 62


def _kind(v: Column) -> Column:
    """The type of a variant, without what is in it."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _with_tools(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``params`` of their tool, null if it has no schema; a name may hold any share of the calls."""
    each = schemas.where("name is not null and param is not null").groupBy("name", "param").agg(
        F.min("type").alias("type"), F.coalesce(F.max("required"), F.lit(False)).alias("required")
    )
    tools = written(each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("params")), "tools")
    size = tools.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length(F.to_json("params"))), F.lit(0))).first()[0]
    if size <= SMALL_BYTES:
        return calls.join(F.broadcast(tools), "name", "left")
    salted = tools.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return calls.withColumn("salt", F.pmod("row", F.lit(_SALTS)).cast("int")).join(salted, ["name", "salt"], "left").drop("salt")


def argument_errors(arguments: Column, name: Column, params: Column) -> Column:
    """The sorted error texts of a call; ``params`` are its tool's."""
    v = F.try_parse_json(arguments)
    given = F.when(_kind(v) == "OBJECT", v.cast("map<string,variant>"))
    kinds = F.transform(F.map_entries(given), lambda e: F.struct(e["key"].alias("key"), _kind(e["value"]).alias("kind")))

    def of_one(e: Column) -> Column:
        known = F.filter(params, lambda p: p["param"] == e["key"])
        want = F.try_element_at(known, F.lit(1))["type"]
        wrong = (e["kind"] != want) & ~(e["kind"].isin(*_NUMBERS) & (want == "DOUBLE"))
        return F.when(F.size(known) == 0, F.concat(e["key"], F.lit(": unknown"))).when(wrong, F.concat(e["key"], F.lit(": "), e["kind"], F.lit(" for "), want))

    needed = F.transform(F.filter(params, lambda p: p["required"]), lambda p: p["param"])
    missing = F.transform(F.array_except(needed, F.map_keys(given)), lambda p: F.concat(p, F.lit(": missing")))
    against = F.concat(F.filter(F.transform(kinds, of_one), lambda x: x.isNotNull()), missing)
    no_schema = F.array(F.concat(F.lit("tool: "), F.coalesce(name, F.lit("")), F.lit(" has no schema")))
    return F.when(given.isNull(), F.array(F.lit("arguments: no object"))).when(params.isNull(), no_schema).otherwise(F.array_sort(F.array_distinct(against)))


def _folded(nodes: Column) -> Column:
    """Levels of calls in one array (``deps`` are places in it, from 1), null in or behind a cycle."""

    def step(levels: Column, _: Column) -> Column:
        open_ = lambda n: F.exists(n["deps"], lambda d: F.element_at(levels, d).isNull())
        level = lambda n: F.coalesce(F.array_max(F.transform(n["deps"], lambda d: F.element_at(levels, d))), F.lit(-1)) + 1
        return F.when(F.exists(levels, lambda x: x.isNull()), F.transform(nodes, lambda n: F.when(~open_(n), level(n)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.size(nodes)), F.transform(nodes, lambda n: F.lit(None).cast("int")), step)


def _levels_in_rows(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``row, level`` of calls in conversations of at most ``FOLDED`` calls."""
    placed = written(calls.select("row", "conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "row")).alias("at")), "placed")
    deps = edges.join(placed.select(F.col("row").alias("dep"), F.col("at").alias("dep_at")), "dep").groupBy("row").agg(F.collect_list("dep_at").alias("deps"))
    each = placed.join(deps, "row", "left").select("conv_id", F.struct("at", "row", F.coalesce("deps", F.array().cast("array<int>")).alias("deps")).alias("n"))
    nodes = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    found = nodes.select(F.explode(F.arrays_zip(F.col("nodes.row").alias("row"), _folded(F.col("nodes")).alias("level"))).alias("f"))
    return found.select("f.row", F.col("f.level").cast("long").alias("level"))


def _levels_by_doubling(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``row, level`` of calls in conversations of any size; null in or behind a cycle.

    ``left`` holds the calls without a level and the least that theirs can be;
    ``needs`` their open dependencies, and by how much a level lies above that of
    one at least.
    """
    spark = calls.sparkSession
    left = written(calls.select("row", F.lit(0).cast("long").alias("least")), "left")
    needs = written(edges.select("row", "dep", F.lit(1).cast("long").alias("far")), "needs")
    paths: list[str] = []
    while True:
        # calls with one open dependency point past others of their kind, twice as far each time
        single = needs.groupBy("row").agg(F.count("*").alias("n"), F.min("dep").alias("dep"), F.max("far").alias("far")).where("n = 1").drop("n")
        ways = written(single.join(left, "row").select("row", "dep", "far", "least"), "ways")
        for _ in range(math.ceil(math.log2(max(2, ways.count()))) + 1):
            beyond = ways.select(F.col("row").alias("dep"), F.col("dep").alias("next"), F.col("far").alias("more"), F.col("least").alias("floor"))
            if not ways.join(beyond, "dep", "left_semi").limit(1).count():
                break
            ways = written(
                ways.join(beyond, "dep", "left").select(
                    "row", F.coalesce("next", "dep").alias("dep"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"),
                    F.greatest("least", F.col("floor") + F.col("far")).alias("least"),
                ),
                "ways",
            )
        # those that still point at their kind point into a cycle
        ended = written(ways.join(ways.select(F.col("row").alias("dep")), "dep", "left_anti"), "ended")
        stuck = ways.join(ended.select("row"), "row", "left_anti").select("row")
        needs = written(needs.join(ways.select("row"), "row", "left_anti").unionByName(ended.select("row", "dep", "far")), "needs")
        raised = left.join(stuck, "row", "left_anti").join(ended.select("row", F.col("least").alias("raised")), "row", "left")
        left = written(raised.select("row", F.coalesce("raised", "least").alias("least")), "left")
        path = scratch_path(spark, "levels")
        left.join(needs, "row", "left_anti").select("row", F.col("least").alias("level")).write.parquet(path)
        free = spark.read.schema("row long, level long").parquet(path)
        if not free.limit(1).count():
            break
        paths.append(path)
        met = needs.join(free.withColumnRenamed("row", "dep"), "dep").groupBy("row").agg(F.max(F.col("level") + F.col("far")).alias("raised"))
        needs = written(needs.join(free.select(F.col("row").alias("dep")), "dep", "left_anti").select("row", "dep", "far"), "needs")
        raised = left.join(free.select("row"), "row", "left_anti").join(met, "row", "left")
        left = written(raised.select("row", F.greatest("least", "raised").alias("least")), "left")
    if not paths:
        return calls.select("row", F.lit(None).cast("long").alias("level"))
    return calls.select("row").join(spark.read.schema("row long, level long").parquet(*paths), "row", "left")


def levels(calls: DataFrame) -> DataFrame:
    """``row, level, place, dangling``: the level or turn that orders a call, the same with cycles last, and dependencies that are unknown or the call itself."""
    identified = calls.where("call_id is not null and conv_id is not null")
    ids = identified.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "row")).alias("first"))
    ids = ids.select("conv_id", F.col("call_id").alias("on"), F.col("first.turn").alias("dep_turn"), F.col("first.row").alias("dep"))
    asked = calls.select("row", "conv_id", "turn", "call_id", F.explode(F.array_distinct("depends_on")).alias("on")).join(ids, ["conv_id", "on"], "left")
    loose = F.col("dep").isNull() | F.coalesce(F.col("on") == F.col("call_id"), F.lit(False))
    asked = written(asked.select("row", "conv_id", "turn", "dep", "dep_turn", loose.alias("loose")), "asked")
    dangling = asked.where("loose").groupBy("row").agg(F.count("*").alias("dangling"))
    edges = asked.where("not loose")
    forward = edges.where("not coalesce(dep_turn < turn, false)").select("conv_id").distinct()
    deep = written(calls.select("row", "conv_id", "turn").join(forward, "conv_id", "left_semi"), "deep")
    placed = calls.select("row", F.col("turn").alias("level"))
    if deep.limit(1).count():
        large = deep.groupBy("conv_id").count().where(F.col("count") > FOLDED).select("conv_id")
        parts = [_levels_in_rows(deep.join(large, "conv_id", "left_anti"), edges.join(large, "conv_id", "left_anti").select("row", "dep").distinct())]
        if large.limit(1).count():
            own = edges.join(large, "conv_id", "left_semi").select("row", "dep").distinct()
            parts.append(_levels_by_doubling(deep.join(large, "conv_id", "left_semi"), own))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        placed = placed.join(deep.select("row"), "row", "left_anti").unionByName(found)
    placed = placed.withColumn("place", F.coalesce("level", F.lit(_LAST)))
    return placed.join(dangling, "row", "left").withColumn("dangling", F.coalesce("dangling", F.lit(0)))


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``rows`` numbered from 0 without gaps in each group: ranges of rows are numbered by themselves, so a group may hold any share of them."""
    piece, before, base = "__piece", "__before", "__base"
    ranged = written(rows.repartitionByRange(group, *order).withColumn(piece, F.spark_partition_id()), "ranged", lasting=True)
    counts = ranged.groupBy(group, piece).agg(F.count("*").alias(before))
    upto = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(group, piece, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(base))
    within = Window.partitionBy(group, piece).orderBy(*order)
    return ranged.join(bases, [group, piece]).withColumn(out, F.col(base) + F.row_number().over(within) - 1).drop(piece, base)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, name, status, seq, level, errors, n_results, dangling and canonical JSON of every call and orphan result."""
    with scratch(calls.sparkSession):
        found = _linked(calls, results, schemas)
    return found.select(
        "conv_id", "call_id", "name", "status", F.col("seq").cast("long").alias("seq"), "level", "errors", "n_results", "dangling", canonical_json().alias("json")
    )


def _linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    calls = written(
        calls.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"),
            F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"),
            F.coalesce("depends_on", _no_texts()).alias("depends_on"), F.monotonically_increasing_id().alias("row"),
        ),
        "calls",
    )
    results = results.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "content"
    )
    named = "conv_id is not null and call_id is not null"
    merged = results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results"))
    merged = merged.select("conv_id", "call_id", F.col("first.turn").alias("result_turn"), F.col("first.content").alias("content"), "n_results")

    checked = _with_tools(calls, schemas).withColumn("errors", argument_errors(F.col("arguments"), F.col("name"), F.col("params")))
    linked = checked.join(merged, ["conv_id", "call_id"], "left").join(levels(calls), "row", "left")
    status = F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unidentified").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    rows = linked.select(
        "conv_id", "turn", "row", "call_id", "name", status.alias("status"), "level", "place", "errors",
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "dangling", "content", "arguments",
    )
    known = calls.where(named).select("conv_id", "call_id").distinct()
    alone = results.where(f"not ({named})").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results"))
    orphans = merged.join(known, ["conv_id", "call_id"], "left_anti").unionByName(alone)
    rows = rows.unionByName(
        orphans.select(
            "conv_id", F.col("result_turn").alias("turn"), F.lit(_LAST).alias("row"), "call_id", F.lit(None).cast("string").alias("name"),
            F.lit("orphan").alias("status"), F.col("result_turn").alias("level"), F.coalesce("result_turn", F.lit(_LAST)).alias("place"), _no_texts().alias("errors"),
            "n_results", F.lit(0).cast("long").alias("dangling"), "content", F.lit(None).cast("string").alias("arguments"),
        )
    )
    # null conversations are no group: their rows are told apart by their row, or what they hold
    own = F.when(F.col("row") < _LAST, F.col("row")).otherwise(F.xxhash64("call_id", "content"))
    group = F.struct(F.col("conv_id").alias("conv"), F.when(F.col("conv_id").isNull(), own).otherwise(F.lit(0)).alias("own"))
    return numbered(rows.withColumn("group", group), "group", ["place", "turn", "row", "call_id", "content"], "seq")


def canonical_json() -> Column:
    """One object with sorted keys, without white space and without null members."""
    return F.to_json(
        F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("content"), F.col("call_id").alias("id"), F.col("name"), F.col("status")),
        {"ignoreNullFields": "true"},
    )


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain chat turns in the shape of tool use, with everything that goes wrong in it.

    A turn of an assistant is the result of the call of the turn before; every
    eighth by its length comes twice, bears an unknown identifier, or none.  Any
    other turn is a call of a tool named by its role (``ask`` for user,
    ``configure`` for system, which have schemas).  By length and turn, arguments
    have a wrong type, an unknown parameter, no text, or are no object.  By
    conversation, calls depend on earlier turns only, on the next but one (a chain
    against the turns), on later and earlier ones and something unknown, or on each
    other and themselves.
    """
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")
    )
    name = lambda later: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + later).cast("string"))
    kind, way, slot = F.pmod(F.col("n") + F.col("turn"), F.lit(10)), F.pmod("conv_id", F.lit(4)), F.pmod("turn", F.lit(4))
    arguments = (
        F.when(kind == 0, F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), "text")))
        .when(kind == 1, F.to_json(F.struct("turn", "text", F.lit(True).alias("extra")))).when(kind == 2, F.to_json(F.struct("turn")))
        .when(kind == 3, F.to_json(F.array("turn"))).when(kind == 4, F.lit("{")).otherwise(F.to_json(F.struct("turn", "text")))
    )
    nowhere = F.lit("nowhere")
    needs = (
        F.when(way == 0, F.array(name(-2))).when(way == 1, F.array(name(2)))
        .when(way == 2, F.when(slot < 2, F.array(name(2), name(-4), nowhere))).otherwise(F.when(slot < 2, F.array(name(2))).otherwise(F.array(name(-2), name(0))))
    )
    is_result = F.col("role").eqNullSafe(F.lit("assistant"))
    calls = own.where(~is_result).select(
        "conv_id", "turn", name(0).alias("call_id"), F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure").otherwise(F.col("role")).alias("name"),
        arguments.alias("arguments"), needs.alias("depends_on"),
    )
    eighth = F.pmod("n", F.lit(8))
    told = F.struct(
        F.col("turn"), F.when(eighth == 1, F.concat(F.lit("x"), name(0))).when(eighth == 2, F.lit(None).cast("string")).otherwise(name(-1)).alias("call_id"), F.col("text").alias("content")
    )
    again = F.struct((F.col("turn") + 1).alias("turn"), name(-1).alias("call_id"), F.concat(F.lit("again: "), "text").alias("content"))
    given = F.explode(F.when(eighth == 0, F.array(told, again)).otherwise(F.array(told))).alias("r")
    results = own.where(is_result).select("conv_id", given).select("conv_id", "r.*")
    each = ", ".join(f"('{n}', '{p}', '{t}', true)" for n in ("ask", "configure") for p, t in (("text", "STRING"), ("turn", "BIGINT")))
    schemas = conversations.sparkSession.sql(f"select * from values {each} as t(name, param, type, required)")
    return calls, results, schemas
