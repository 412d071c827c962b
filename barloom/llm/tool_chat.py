"""Chat messages with tool calls linked to results, ordered, checked and serialised.

Calls and results meet in a hash join on conversation and identifier. Calls are then
put in an order in which each follows the calls it depends on: calls without open
dependencies take level 0, and level by level the ones they free. Arguments are checked
against the tool's schema, and each exchange is written as canonical JSON: keys in
order, no blanks, numbers and strings in one form.

Everything is DataFrame work. A position in a conversation is counted over stretches of
``STRETCH`` turns, so a very long conversation never meets in one task; identifiers that
repeat are reduced to one call and one result before the join. Levels take one round of
joins for each step of the longest chain of dependencies.

Nulls and the like: a call without an identifier has no result and cannot be depended
on; of calls (or results) that share one, the first by turn and content counts, and the
others keep their rows as ``repeated``. Results nobody called for, and repeated ones, have
no row in ``format_calls``; ``unlinked`` returns them, and ``format_chat`` keeps them and all
other messages as rows of their own. Long texts are taken whole. A
dependency that names no call is ignored, calls in a cycle come last and have no level.
Arguments that are null or no JSON object are invalid, as is an unknown tool. Equal
turns are ordered by identifier and arguments. Empty tables give empty results; columns
that the inputs have besides the named ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.scratch import stored

STRETCH = 256

#: JSON kinds of a schema, and the names that Spark's variant type gives them.
KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "(BIGINT|DOUBLE|DECIMAL.*)",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
}


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` with the ``result`` of the same conversation and identifier, and ``status``.

    ``calls`` has ``conv_id``, ``turn``, ``call_id``, ``name``, ``arguments`` and
    ``depends_on`` (an array of identifiers); ``results`` has ``conv_id``, ``turn``,
    ``call_id`` and ``content``.
    """
    keys = ["conv_id", "call_id"]
    chosen = results.where("conv_id is not null and call_id is not null").groupBy(*keys).agg(
        F.min(F.struct("turn", "content")).getField("content").alias("result"), F.lit(True).alias("has_result")
    )
    order = F.struct("turn", "name", "arguments")
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    firsts = calls.where(named).groupBy(*keys).agg(F.min(order).alias("first"))
    known = calls.join(firsts.hint("shuffle_hash"), keys, "left").join(chosen.hint("shuffle_hash"), keys, "left")
    repeated = F.coalesce(F.col("first") != order, F.lit(False))
    status = F.when(repeated, "repeated").when(F.col("has_result"), "linked").otherwise("pending")
    return known.select(
        "conv_id", "turn", "call_id", "name", "arguments", "depends_on",
        F.when(~repeated, F.col("result")).alias("result"), status.alias("status"),
    )


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The ``results`` that ``link`` gives to no call, with ``status``: orphan or repeated.

    An orphan has no call of its conversation and identifier, or lacks one of the two; a
    repeated one differs from the first result of its identifier, which the call has.
    """
    keys = ["conv_id", "call_id"]
    order = F.struct("turn", "content")
    called = calls.select(*keys).where("conv_id is not null and call_id is not null").distinct()
    firsts = results.groupBy(*keys).agg(F.min(order).alias("first"))
    known = firsts.join(called.withColumn("called", F.lit(True)).hint("shuffle_hash"), keys)
    status = F.when(F.col("called").isNull(), "orphan").when(~F.col("first").eqNullSafe(order), "repeated")
    rows = results.join(known.hint("shuffle_hash"), keys, "left").withColumn("status", status)
    return rows.where("status is not null").select("conv_id", "turn", "call_id", "content", "status")


def levels(linked: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id`` and the ``level`` of every call that others may depend on."""
    keys = ["conv_id", "call_id"]
    named = linked.where("status <> 'repeated' and call_id is not null and conv_id is not null")
    nodes = stored(named.select(*keys).distinct(), "calls")
    needs = stored(
        named.select(*keys, F.explode(F.array_distinct("depends_on")).alias("needs"))
        .join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"])
        .where("needs <> call_id"),
        "needs",
    )
    open_calls, done, level = nodes, [], 0
    while True:
        waiting = needs.join(open_calls.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
        waiting = stored(open_calls.join(waiting, keys, "left_semi"), "waiting")
        freed = stored(open_calls.join(waiting, keys, "left_anti").withColumn("level", F.lit(level)), "level")
        if freed.isEmpty():
            break
        done.append(freed)
        open_calls, level = waiting, level + 1
    ordered = freed
    for part in done:
        ordered = ordered.union(part)
    return ordered


def tool_fields(schemas: DataFrame) -> DataFrame:
    """One row per tool ``name`` with its ``fields``, from rows of name, key, kind, required."""
    return schemas.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("key", "kind", "required"))).alias("fields"))


def argument_errors(arguments: Column, fields: Column) -> Column:
    """What is wrong with JSON arguments, as sorted short texts; empty if nothing is."""
    found = F.from_json(arguments, "map<string,variant>")

    def of_kind(field: Column) -> Column:
        named = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
        return F.concat(F.lit("^"), F.coalesce(F.try_element_at(named, field.kind), F.lit(".*")), F.lit("$"))

    def judge(field: Column) -> Column:
        value = F.try_element_at(found, field.key)
        wrong = ~F.rlike(F.schema_of_variant(value), of_kind(field))
        return (
            F.when(value.isNull() & field.required, F.concat(F.lit("missing:"), field.key))
            .when(value.isNotNull() & wrong, F.concat(F.lit("kind:"), field.key))
        )

    keys = F.transform(fields, lambda f: f.key)
    unknown = F.transform(F.array_except(F.map_keys(found), keys), lambda k: F.concat(F.lit("unknown:"), k))
    wrong = F.filter(F.transform(fields, judge), lambda e: e.isNotNull())
    return (
        F.when(fields.isNull(), F.array(F.lit("tool")))
        .when(found.isNull(), F.array(F.lit("json")))
        .otherwise(F.array_sort(F.concat(wrong, unknown)))
    )


def exchange_json(valid: Column) -> Column:
    """One row as canonical JSON: a call with its result, a result alone, or a message.

    Invalid arguments are kept as their text.
    """
    rest = [F.col("call_id").alias("id"), "name", "result", F.lit("function").alias("type")]
    as_object = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), *rest))
    as_text = F.to_json(F.struct("arguments", *rest))
    content = F.col("result").alias("content")
    alone = F.to_json(F.struct(content, F.col("call_id").alias("id"), F.lit("result").alias("type")))
    message = F.to_json(F.struct(content, F.col("name").alias("role"), F.lit("message").alias("type")))
    return (
        F.when(F.col("part") == "result", alone).when(F.col("part") == "message", message)
        .when(valid, as_object).otherwise(as_text)
    )


def positions(ordered: DataFrame) -> DataFrame:
    """``ordered`` with each row's ``position`` in its conversation, without gaps from 0.

    Rows are counted per level and stretch of turns; a window over these counts gives
    where each stretch starts, another numbers the rows inside it.
    """
    last = F.coalesce("level", F.lit(2**31 - 1)).alias("_level")
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-1)).alias("_stretch")
    rows = ordered.select("*", last, stretch)
    keys = ["conv_id", "_level", "_stretch"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_level", "_stretch")) - F.col("_n")
    starts = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], before.alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("turn", "call_id", "name", "arguments", "result")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, same[0] & same[1] & same[2])
        .withColumn("position", F.col("_before") + F.col("_in"))
        .drop("_level", "_stretch", "_before", "_in", *[f"{k}_" for k in keys])
    )


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: its place, level, status, errors and canonical JSON."""
    return _formatted(_leveled(calls, results), schemas)


def format_chat(calls: DataFrame, results: DataFrame, messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """``format_calls`` with a row for everything else that was said.

    ``messages`` has ``conv_id``, ``turn``, ``role`` and ``text``; they come first in their
    conversation, by turn, with status ``message``. Results of no call and repeated ones
    come last, with their status of ``unlinked``. Both have level -1 and no errors.
    """
    alone = unlinked(calls, results).select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.col("content").alias("result"), "status", F.lit("result").alias("part"), F.lit(None).cast("int").alias("level"),
    )
    said = messages.select(
        "conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.col("role").alias("name"),
        F.lit(None).cast("string").alias("arguments"), F.col("text").alias("result"),
        F.lit("message").alias("status"), F.lit("message").alias("part"), F.lit(-1).alias("level"),
    )
    return _formatted(_leveled(calls, results).unionByName(alone).unionByName(said), schemas)


def _leveled(calls: DataFrame, results: DataFrame) -> DataFrame:
    linked = stored(link(calls, results), "linked")
    rows = linked.join(levels(linked), ["conv_id", "call_id"], "left").drop("depends_on")
    return rows.withColumn("part", F.lit("call"))


def _formatted(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    is_call = F.col("part") == "call"
    placed = positions(rows)
    level = F.when(~is_call, -1).when(F.col("status") != "repeated", F.col("level"))
    found = F.when(is_call, argument_errors(F.col("arguments"), F.col("fields"))).otherwise(F.array().cast("array<string>"))
    checked = placed.join(tool_fields(schemas), "name", "left").withColumn("errors", found)
    valid = F.size("errors") == 0
    return checked.select(
        "conv_id", "position", "turn", "call_id", F.when(is_call, F.col("name")).alias("name"), level.alias("level"), "status",
        valid.alias("valid"), F.array_join("errors", ";").alias("errors"), exchange_json(valid).alias("json"),
    )
