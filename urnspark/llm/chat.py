"""Chat formatting: tool calls linked to results, ordered, validated, as canonical JSON (operator 1). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.packing import running_offsets
from urnspark.llm.shared import BLANK_RUN, append, drop, folder, read, stage, words_of

#: What the text of an argument must look like, by type of the schema.
TYPES = {"integer": r"^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$", "boolean": r"^(true|false)$", "string": r"^[\s\S]*$"}


def quoted(s):
    """Column: s as a JSON string."""
    j = F.to_json(F.struct(F.coalesce(s, F.lit("")).alias("v")))
    return F.substring(j, F.lit(6), F.length(j) - 6)


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; the others are repeats."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_m")).select(*keys, *(F.col("_m")[c].alias(c) for c in rest))


KEYS = ["conv_id", "call_id"]


def _jumped(single: DataFrame) -> DataFrame:
    """conv_id, call_id, ptr, dist, done: for calls with one dependency, the first call back that hasn't just one.

    single: conv_id, call_id, ptr (the dependency). Pointers double their reach in each round, so a chain takes as many
    rounds as the logarithm of its length; when a round ends none, what is left is on or behind a cycle.
    """
    back = single.select("conv_id", F.col("call_id").alias("ptr"), F.lit(True).alias("goes_on"))
    now = single.join(back, ["conv_id", "ptr"], "left").select(*KEYS, "ptr", F.lit(1).cast("bigint").alias("dist"), F.col("goes_on").isNull().alias("done"))
    now = stage(now, "call-jumps")
    open_ = now.where("not done").count()
    while open_:
        step = now.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        more = now.where("not done").join(step, ["conv_id", "ptr"]).select(*KEYS, F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"))
        new = stage(now.where("done").unionByName(more), "call-jumps")
        drop(now)
        now, before, open_ = new, open_, new.where("not done").count()
        if open_ == before:
            break
    return now


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 without dependencies, else one above the highest of them; null on or behind a cycle.

    Calls with one dependency are contracted by pointer jumping. What is left, calls with none or several, is peeled: each
    round settles the calls all of whose dependencies are settled. Rounds append to one folder that is read once, so
    plans stay as they are however many rounds there are. Dependencies on calls that don't exist don't count.
    """
    spark = calls.sparkSession
    ids = calls.select(*KEYS)
    deps = calls.select(*KEYS, F.explode("depends_on").alias("dep")).distinct()
    deps = stage(deps.join(ids.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi"), "call-edges")
    need = stage(deps.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("ptr")), "call-needs")
    jumps = _jumped(need.where("n = 1").select(*KEYS, "ptr"))
    path = folder(spark, "call-levels")
    front = append(ids.join(need, KEYS, "left_anti").select(*KEYS, F.lit(0).cast("bigint").alias("level")), path, 0)
    several = need.where("n > 1").select(*KEYS, "n")
    left = stage(several.select(*KEYS, "n", F.lit(0).cast("bigint").alias("met"), F.lit(0).cast("bigint").alias("best")), "call-waits")
    if not left.isEmpty():
        ends = jumps.select("conv_id", F.col("call_id").alias("dep"), "ptr", "dist", "done")
        edges = deps.join(several.select(*KEYS), KEYS, "left_semi").join(ends, ["conv_id", "dep"], "left")
        # An edge into a cycle is never met.
        edges = edges.where(F.coalesce("done", F.lit(True))).select(*KEYS, F.coalesce("ptr", "dep").alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("far"))
        edges = stage(edges, "call-far-edges")
        k = 0
        while not front.isEmpty():
            k += 1
            met = edges.join(front.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("more"), F.max(F.col("level") + F.col("far")).alias("high"))
            now = stage(left.join(met, KEYS, "left").select(*KEYS, "n", (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"), F.greatest("best", F.coalesce("high", F.lit(0))).alias("best")), "call-waits")
            drop(left)
            front = append(now.where("met = n").select(*KEYS, F.col("best").alias("level")), path, k)
            left = stage(now.where("met < n"), "call-waits")
            drop(now)
    settled = spark.read.schema(front.schema).parquet(f"{path}/*")
    behind = jumps.where("done").select("conv_id", "call_id", F.col("ptr"), "dist").join(settled.select("conv_id", F.col("call_id").alias("ptr"), "level"), ["conv_id", "ptr"])
    done = settled.unionByName(behind.select(*KEYS, (F.col("level") + F.col("dist")).alias("level")))
    return ids.join(done, KEYS, "left").withColumn("level", F.col("level").cast("int"))


def _placed(levelled: DataFrame) -> DataFrame:
    """conv_id, call_id, place: from 0 in each conversation, by level, at, call_id; calls without a level have none.

    All calls are numbered in one range-sorted order, and each conversation counts from its first, so that a conversation
    of any length is dealt to many tasks.
    """
    rows = stage(levelled.where("level IS NOT NULL").withColumn("one", F.lit(1).cast("bigint")), "call-order")
    placed = stage(running_offsets(rows, ["conv_id", "level", "at", "call_id"], "one").select(*KEYS, "before"), "call-places")
    first = placed.groupBy("conv_id").agg(F.min("before").alias("first"))
    return placed.join(first, "conv_id").select(*KEYS, (F.col("before") - F.col("first")).alias("place"))


def _number(v):
    """Column: a number's canonical text: whole ones below 10**15 without a point, others as the shortest double; null if not finite."""
    d = v.try_cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, F.when(F.abs(d) < 1e15, d).cast("bigint").cast("string")).when(F.abs(d) < float("inf"), F.lower(F.regexp_replace(d.cast("string"), r"\.0E", "E")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call, and per result without a call: status, level, place, problems and canonical JSON.

    calls: conv_id, call_id, at, name, arguments (map of text), depends_on (array of call ids). results: conv_id,
    call_id, at, content. schemas: name, params (array of struct param, type, required); of a tool named twice, the
    least params count. Repeats of an id in a conversation: the first by at, then by content, counts. status: linked,
    early (the result stands before its call), no_result, no_call. place: a topological order of the conversation from 0,
    by level, then at, then id; none on or behind a cycle. problems: of the arguments, sorted: unknown_tool, missing:p,
    unexpected:p, type:p. json: keys sorted, no blanks, values by the schema's type where they conform, else as strings;
    numbers that are equal are written alike. Null maps, arrays and texts are empty. A call or result with a null id is
    a row of its own, without level and place, linked to none.
    """
    args = F.coalesce(F.col("arguments"), F.create_map().cast("map<string,string>"))
    calls = calls.select(*KEYS, "at", "name", F.array_sort(F.map_entries(args)).alias("args"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = results.select(*KEYS, F.col("at").alias("result_at"), F.coalesce("content", F.lit("")).alias("content"))
    lost = F.col("conv_id").isNull() | F.col("call_id").isNull()
    c = stage(_first(calls.where(~lost), KEYS, ["at"]), "calls")
    r = _first(results.where(~lost), KEYS, ["result_at"])
    levelled = stage(levels(c).join(c.select(*KEYS, "at"), KEYS), "call-levelled")
    both = c.join(levelled.drop("at"), KEYS, "left").join(_placed(levelled), KEYS, "left").join(r, KEYS, "full_outer")
    for alone in (calls, results):
        both = both.unionByName(alone.where(lost), allowMissingColumns=True)
    both = both.join(schemas.where("name IS NOT NULL").groupBy(F.col("name").alias("_tool")).agg(F.min("params").alias("params")), F.col("name") == F.col("_tool"), "left")
    has = lambda p: F.exists("args", lambda e: e["key"] == p)
    fits = lambda v, kind: F.coalesce(*(F.when(kind == t, v.rlike(rx) & (F.lit(t != "number") | _number(v).isNotNull())) for t, rx in TYPES.items()), F.lit(True))
    params = F.col("params")
    wrong = F.concat(
        F.transform(F.filter(params, lambda q: q["required"] & ~has(q["param"])), lambda q: F.concat(F.lit("missing:"), q["param"])),
        F.transform(F.filter("args", lambda e: ~F.exists(params, lambda q: q["param"] == e["key"])), lambda e: F.concat(F.lit("unexpected:"), e["key"])),
        F.transform(F.filter("args", lambda e: F.exists(params, lambda q: (q["param"] == e["key"]) & ~fits(e["value"], q["type"]))), lambda e: F.concat(F.lit("type:"), e["key"])),
    )
    problems = F.when(F.col("args").isNull(), F.array().cast("array<string>")).when(params.isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.array_sort(wrong))
    known = F.coalesce(params, F.array().cast("array<struct<param:string,type:string,required:boolean>>"))
    is_ = lambda e, *kinds: F.exists(known, lambda q: (q["param"] == e["key"]) & q["type"].isin(*kinds) & fits(e["value"], q["type"]))
    value = lambda e: F.when(is_(e, "integer") & (e["value"] == "-0"), "0").when(is_(e, "integer", "boolean"), e["value"]).when(is_(e, "number"), _number(e["value"])).otherwise(quoted(e["value"]))
    body = F.array_join(F.transform("args", lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e))), ",")
    args_json = F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}"))
    json = F.concat(
        F.lit('{"arguments":'), args_json, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), F.when(F.col("content").isNull(), F.lit("null")).otherwise(quoted(F.col("content"))), F.lit("}"),
    )
    status = F.when(F.col("args").isNull(), "no_call").when(F.col("content").isNull(), "no_result").when(F.col("result_at") <= F.col("at"), "early").otherwise("linked")
    return both.select(*KEYS, "at", "result_at", "name", "level", "place", status.alias("status"), problems.alias("problems"), json.alias("json"))


def from_conversations(conv: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that a table of turns stands for.

    A user turn calls a tool (by its number of words: search, lookup or measure) and depends on the conversation's user
    turn two before; the assistant turn after a turn is its result.
    """
    n = F.size(words_of(F.col("text")))
    user = conv.where("role = 'user'")
    calls = user.select(
        "conv_id",
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"),
        F.col("turn").alias("at"),
        F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("measure")), n % 3 + 1).alias("name"),
        F.map_from_arrays(F.array(F.lit("text"), F.lit("words"), F.lit("turn")), F.array(F.coalesce("text", F.lit("")), n.cast("string"), F.col("turn").cast("string"))).alias("arguments"),
        F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))).alias("depends_on"),
    )
    results = conv.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("at"), F.col("text").alias("content"))
    rows = [
        ("search", [("text", "string", True), ("words", "integer", True), ("turn", "integer", False)]),
        ("lookup", [("text", "string", True), ("key", "string", True), ("words", "integer", False), ("turn", "integer", False)]),
        ("measure", [("text", "number", True), ("words", "integer", True)]),
    ]
    param = lambda p, t, r: F.struct(F.lit(p).alias("param"), F.lit(t).alias("type"), F.lit(r).alias("required"))
    tools = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*(param(*q) for q in qs)).alias("params")) for n, qs in rows))
    return calls, results, conv.sparkSession.range(1).select(F.inline(tools))


def op1_chat_tool_links(spark, sf_dir: str) -> DataFrame:
    out = link_calls(*from_conversations(read(spark, sf_dir, "conversations")))
    return out.select("conv_id", "call_id", "at", "result_at", "name", "level", "place", "status", F.array_join("problems", ",").alias("problems"), F.length("json").cast("bigint").alias("json_chars"), F.md5(F.col("json").cast("binary")).alias("json_md5"))


_SQL = f"""
WITH u AS (SELECT conv_id, 'c' || turn AS call_id, turn AS pos, coalesce(text, '') AS text,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK_RUN}'), lambda s: s <> '')) AS n FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, call_id, pos, text, n, ['search', 'lookup', 'measure'][n % 3 + 1] AS name FROM u
    QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY pos, ['search', 'lookup', 'measure'][n % 3 + 1], text) = 1),
a AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, turn AS result_at, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(text, '')) = 1),
g AS (SELECT conv_id, call_id, pos, pos - 2 * row_number() OVER (PARTITION BY conv_id, pos % 2 ORDER BY pos) AS grp FROM c),
l AS (SELECT conv_id, call_id, CAST(row_number() OVER (PARTITION BY conv_id, pos % 2, grp ORDER BY pos) - 1 AS INTEGER) AS level FROM g),
j AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.pos, a.result_at, c.name, l.level, c.n, c.text, a.content
    FROM c LEFT JOIN l ON l.conv_id = c.conv_id AND l.call_id = c.call_id FULL JOIN a ON a.conv_id = c.conv_id AND a.call_id = c.call_id),
k AS (SELECT *, CASE name WHEN 'search' THEN '' WHEN 'lookup' THEN 'missing:key' WHEN 'measure' THEN
    CASE WHEN regexp_full_match(text, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?') THEN 'unexpected:turn' ELSE 'type:text,unexpected:turn' END ELSE '' END AS problems,
    CASE WHEN name IS NULL THEN '{{}}' ELSE '{{"text":' || CASE WHEN name = 'measure' AND regexp_full_match(text, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?') THEN text ELSE CAST(to_json(text) AS VARCHAR) END
      || ',"turn":' || CASE WHEN name = 'measure' THEN '"' || pos || '"' ELSE '' || pos END || ',"words":' || n || '}}' END AS args FROM j),
m AS (SELECT *, '{{"arguments":' || args || ',"id":"' || call_id || '","name":"' || coalesce(name, '') || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}}' AS json FROM k)
SELECT conv_id, call_id, pos AS "at", result_at, name, level, CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, level IS NULL ORDER BY level, pos, call_id) - 1 END AS place, CASE WHEN name IS NULL THEN 'no_call' WHEN content IS NULL THEN 'no_result' WHEN result_at <= pos THEN 'early' ELSE 'linked' END AS status,
    problems, CAST(length(json) AS BIGINT) AS json_chars, md5(json) AS json_md5 FROM m"""

QUERIES = {"op1_chat_tool_links": op1_chat_tool_links}
ORACLE_SQL = {"op1_chat_tool_links": _SQL}
