"""Chat formatting with tool-call linking, in DataFrame functions only.

Calls and results are hash-joined by identifier, calls are put in topological order of what they wait for, arguments
are checked against the tools' schemas, and each linked call is written as canonical JSON (keys sorted, no blanks). Rows come
out in that order: by level, then identifier.

A call may wait for several others. Its level is the length of the longest way to a call that waits for none. Calls that wait
for one call form chains, which are folded by doubling, in rounds that grow with the logarithm of a chain's length; the calls
where ways meet are then settled once all that they wait for is.

Defined results: a call without a result has linked false and a null result; of several results of one call the least
counts; a result without a call is left out (``orphans`` lists them); waiting for an unknown call, a null one or none is waiting for
nothing; a call in a cycle, or waiting for one, has no level. Arguments that aren't a JSON object (null and empty ones too), and tools without a
schema, are errors. Repeated rows give repeated rows; rows with one call_id wait for all that any of them waits for; a null call_id is
never linked and has no level. Texts of any length are kept whole. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Most tools that are broadcast with their schemas; more are joined by a shuffle.
MOST_TOOLS = 10_000


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, after array<string>) to (call_id, level), null in or behind a cycle."""
    known = written(calls.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n")).select("call_id"), "calls")
    waits = calls.select("call_id", F.explode("after").alias("other")).filter("call_id is not null and other is not null").distinct()
    waits = written(waits.join(known.withColumnRenamed("call_id", "other").hint("merge"), "other"), "waits")
    fan = waits.groupBy("call_id").agg(F.count("*").alias("n"), F.min("other").alias("other"))
    # A link of a chain points at what it waits for; all other calls are ends, at distance 0 from themselves.
    state = known.join(fan.hint("merge"), "call_id", "left").select("call_id", F.when(F.col("n") == 1, F.col("other")).alias("jump"), F.col("call_id").alias("end"), F.lit(0).cast("long").alias("far"), F.coalesce("n", F.lit(0)).alias("n"))
    state = written(state.withColumn("end", F.coalesce("jump", "end")).withColumn("far", F.when(F.col("jump").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")), "chains")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.filter("jump is not null").isEmpty():
            break
        target = state.select(F.col("call_id").alias("at"), F.col("jump").alias("further"), F.col("end").alias("last"), F.col("far").alias("more"))
        moved = state.join(target.hint("merge"), F.col("jump") == F.col("at"), "left")
        on = F.col("jump").isNotNull()
        state = written(moved.select("call_id", F.col("further").alias("jump"), F.when(on, F.col("last")).otherwise(F.col("end")).alias("end"), (F.col("far") + F.when(on, F.col("more")).otherwise(F.lit(0))).alias("far"), "n"), "chains")
    chains = state.filter("jump is null")  # what still points somewhere leads into a cycle of single waits
    done = written(chains.filter("n = 0").select("call_id", F.lit(0).cast("long").alias("level")), "settled")
    meets = state.filter("n > 1").select("call_id", "n")
    if not meets.isEmpty():
        ways = waits.join(meets.hint("merge"), "call_id").join(chains.select(F.col("call_id").alias("other"), F.col("end").alias("from"), F.col("far").alias("far")).hint("merge"), "other")
        ways = written(ways.select("call_id", "n", "from", (F.col("far") + 1).alias("far")), "ways")
        fresh, reached = done, None
        while True:
            new = ways.join(fresh.select(F.col("call_id").alias("from"), "level").hint("merge"), "from").groupBy("call_id", "n").agg(F.count("*").alias("k"), F.max(F.col("far") + F.col("level")).alias("level"))
            reached = written(new if reached is None else reached.unionByName(new).groupBy("call_id", "n").agg(F.sum("k").alias("k"), F.max("level").alias("level")), "reached")
            fresh = reached.filter("k = n").select("call_id", "level")
            if fresh.isEmpty():
                break
            fresh, reached = written(fresh, "fresh"), reached.filter("k < n")
            done = done.unionByName(fresh)
    ends = chains.join(written(done, "levels").withColumnRenamed("call_id", "end").hint("merge"), "end").select("call_id", (F.col("far") + F.col("level")).alias("level"))
    return known.join(ends.hint("merge"), "call_id", "left")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call asked for."""
    return results.join(calls.select("call_id").hint("shuffle_hash"), "call_id", "left_anti")


#: What a schema's type stands for, as the type of a JSON value.
_KINDS = {"string": "^STRING", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def link_tools(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """call_id, name, linked, level, valid, errors, json of every call, in topological order.

    calls: call_id, name, arguments (JSON text), after (array of call_ids or null); results: call_id, content;
    schemas: name, fields array<struct<field, type, required, most>> (type: string, number, integer, boolean, array or object;
    most: the greatest number or null).
    """
    calls = calls.select("call_id", "name", "arguments", "after")
    got = written(results.groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n")), "results")
    levels_ = levels(calls)
    rows = calls.drop("after").join(got.hint("shuffle_hash"), "call_id", "left").join(levels_.hint("shuffle_hash"), "call_id", "left")
    tools = schemas.groupBy("name").agg(F.first("fields").alias("fields"))
    rows = rows.join(F.broadcast(tools) if schemas.count() <= MOST_TOOLS else tools.hint("shuffle_hash"), "name", "left")
    rows = rows.withColumn("object", F.expr("try_parse_json(arguments)"))
    is_object = F.coalesce(F.expr("schema_of_variant(object)").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("values", F.when(is_object, F.from_json("arguments", "map<string,string>"))).withColumn("kinds", F.when(is_object, F.from_json("arguments", "map<string,variant>")))

    def problem(f):
        value, found = F.try_element_at(F.col("values"), f["field"]), F.schema_of_variant(F.try_element_at(F.col("kinds"), f["field"]))
        number = value.try_cast("double")
        shape = F.element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), f["type"])
        wrong = ~F.regexp(found, shape) | ((f["type"] == "integer") & (number != F.floor(number)))
        return (
            F.when(value.isNull(), F.when(f["required"], F.concat(f["field"], F.lit(" is missing"))))
            .when(wrong, F.concat(f["field"], F.lit(" is no "), f["type"]))
            .when((f["type"] == "string") & (value == ""), F.concat(f["field"], F.lit(" is empty")))
            .when(f["type"].isin("number", "integer") & (number > f["most"]), F.concat(f["field"], F.lit(" is too large")))
        )

    errors = F.when(F.col("fields").isNull(), F.array(F.lit("no schema"))).when(~is_object, F.array(F.lit("no object"))).otherwise(F.array_compact(F.transform("fields", problem)))
    rows = rows.withColumn("errors", F.array_join(errors, "; "))
    line = F.struct(F.when(is_object, F.col("object")).alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"))
    out = rows.select("call_id", "name", F.col("n").isNotNull().alias("linked"), "level", (F.col("errors") == "").alias("valid"), "errors", F.to_json(line).alias("json"))
    return out.orderBy(F.col("level").asc_nulls_last(), "call_id")
