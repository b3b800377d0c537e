"""Event logs of trials to metrics, tool calls, transcripts and scores.

Events are one JSON object a line: assistant messages with text and tool_use blocks, user messages with tool_result
blocks, and a last result event. Tables carry trial_id and line_no.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tool names that stand for the index, and those that go to the web.
INDEX_PREFIX = "mcp__"
WEB_TOOLS = ("WebSearch", "WebFetch")
PREVIEW = 500
_USAGE = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")


def taken(v: str | Column, path: str, kind: str) -> Column:
    """What a variant holds at path as that type, where it can be taken as such; else null."""
    return F.try_variant_get(v, path, kind)


def whole(v: str | Column, path: str) -> Column:
    """A count, whichever way it is written: 7, 7.0 or "7"."""
    return F.coalesce(taken(v, path, "bigint"), taken(v, path, "double").cast("bigint"), taken(v, path, "string").try_cast("double").try_cast("bigint"))


def parse_events(lines: DataFrame) -> DataFrame:
    """lines: trial_id, line_no, value. (trial_id, line_no, type, content, total_cost_usd, duration_ms, num_turns, usage,
    result, event): what the metrics ask for, and the whole event as a variant.

    Lines that aren't JSON objects with a type are left out. A value of another form than asked for is taken as far as it
    can be, and touches no other: counts may be written 7, 7.0 or "7", and content may hold blocks of any kind.
    """
    parsed = lines.select("trial_id", "line_no", F.try_parse_json("value").alias("event"))
    usage = F.struct(*[whole("event", f"$.usage.{c}").alias(c) for c in _USAGE])
    out = parsed.select(
        "trial_id", "line_no", taken("event", "$.type", "string").alias("type"), taken("event", "$.message.content", "array<variant>").alias("content"), taken("event", "$.total_cost_usd", "double").alias("total_cost_usd"),
        whole("event", "$.duration_ms").alias("duration_ms"), whole("event", "$.num_turns").alias("num_turns"), usage.alias("usage"), taken("event", "$.result", "string").alias("result"), "event",
    )
    return out.where("type IS NOT NULL")


_FIELDS = ("type", "id", "name", "text", "input", "tool_use_id")


def _blocks(events: DataFrame, who: str) -> DataFrame:
    """A row for each block; what isn't an object has nulls."""
    each = events.where(F.col("type") == who).select("trial_id", "line_no", F.posexplode("content").alias("place", "b"))
    return each.select("trial_id", "line_no", "place", *[taken("b", f"$.{c}", "string").alias(c) for c in _FIELDS], taken("b", "$.content", "array<variant>").alias("parts"), taken("b", "$.content", "string").alias("content"))


def efficiency(events: DataFrame) -> DataFrame:
    """One row for each trial: cost, tokens, time and turns of its last result event, zeros without one."""
    last = events.groupBy("trial_id").agg(F.max_by(F.struct("total_cost_usd", "duration_ms", "num_turns", "usage", "result"), F.when(F.col("type") == "result", F.col("line_no"))).alias("r"))
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0))
    tokens = zero("usage.input_tokens") + zero("usage.cache_read_input_tokens") + zero("usage.cache_creation_input_tokens")
    return last.select("trial_id", F.coalesce("r.total_cost_usd", F.lit(0.0)).alias("total_cost_usd"), tokens.alias("input_tokens"), zero("usage.output_tokens").alias("output_tokens"), zero("duration_ms").alias("duration_ms"), zero("num_turns").alias("num_turns"), F.coalesce("r.result", F.lit("")).alias("response"))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def behavior(events: DataFrame) -> DataFrame:
    """One row for each trial: counts of tool calls by kind, the index's tools used, and their share of all calls."""
    used = _blocks(events, "assistant").where(F.col("type") == "tool_use").select("trial_id", F.coalesce("name", F.lit("")).alias("name"))
    index = F.col("name").startswith(INDEX_PREFIX)
    counts = used.groupBy("trial_id").agg(F.count_if(index).alias("index_calls"), F.array_sort(F.collect_set(F.when(index, F.col("name")))).alias("index_tools"), F.count_if(~index).alias("other_calls"), F.count("*").alias("total_calls"), F.count_if(F.col("name").isin(*WEB_TOOLS)).alias("web_calls"))
    every = events.select("trial_id").distinct().join(counts, "trial_id", "left")
    filled = every.fillna(0, ["index_calls", "other_calls", "total_calls", "web_calls"]).withColumn("index_tools", F.coalesce("index_tools", F.array().cast("array<string>")))
    return filled.withColumn("engagement", ratio(F.col("index_calls"), F.col("total_calls")))


def tool_calls(events: DataFrame) -> DataFrame:
    """(trial_id, id, tool, input, output_length, output_preview): each call beside its result, "" without one."""
    calls = _blocks(events, "assistant").where("type = 'tool_use'").groupBy("trial_id", "id").agg(F.max_by("name", F.struct("line_no", "place")).alias("tool"), F.max_by(F.coalesce("input", F.lit("{}")), F.struct("line_no", "place")).alias("input"))
    listed = F.array_join(F.transform("parts", lambda p: F.coalesce(taken(p, "$.text", "string"), F.lit(""))), "\n")
    text = F.coalesce(listed, "content", F.lit(""))
    given = _blocks(events, "user").where("type = 'tool_result'").select("trial_id", F.coalesce("tool_use_id", F.lit("")).alias("id"), "line_no", "place", text.alias("output"))
    given = given.groupBy("trial_id", "id").agg(F.max_by("output", F.struct("line_no", "place")).alias("output"))
    both = calls.join(given, ["trial_id", "id"], "left").withColumn("output", F.coalesce("output", F.lit("")))
    size = F.length("output")
    return both.select("trial_id", "id", "tool", "input", size.alias("output_length"), F.when(size > PREVIEW, F.concat(F.substring("output", 1, PREVIEW), F.lit("..."))).otherwise(F.col("output")).alias("output_preview"))


def transcripts(events: DataFrame) -> DataFrame:
    """(trial_id, transcript): what was said and called, in order, as Markdown."""
    own = _blocks(events, "assistant")
    said = F.when((F.col("type") == "text") & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.concat(F.lit("## Assistant\n\n"), F.trim("text"), F.lit("\n"))).when(F.col("type") == "tool_use", F.concat(F.lit("**Tool call:** `"), F.coalesce("name", F.lit("")), F.lit("`\n")))
    last = events.where("type = 'result' AND result <> ''").select("trial_id", "line_no", F.lit(0).alias("place"), F.concat(F.lit("## Final Response\n\n"), "result", F.lit("\n")).alias("part"))
    parts = own.select("trial_id", "line_no", "place", said.alias("part")).where("part IS NOT NULL").unionByName(last)
    joined = parts.groupBy("trial_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "place", "part"))).alias("p"))
    head = F.lit("# Conversation Transcript\n")
    return joined.select("trial_id", F.array_join(F.concat(F.array(head), F.transform("p", lambda p: p["part"])), "\n").alias("transcript"))


def fact_scores(responses: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """responses: keys, task_id, response. facts: task_id, pattern, weight. Weight of the patterns found over all;
    1 for a task without facts, 0 where the weights add up to 0.

    A task's facts go to its responses, which stay where they are; only keys and sums are moved."""
    asked = facts.groupBy("task_id").agg(F.collect_list(F.struct("pattern", "weight")).alias("facts"))
    tested = responses.join(F.broadcast(asked), "task_id", "left").select(*keys, "response", F.explode_outer("facts").alias("fact"))
    hit = F.when(F.regexp_like("response", F.concat(F.lit("(?i)"), "fact.pattern")), F.col("fact.weight")).otherwise(0.0)
    summed = tested.groupBy(*keys).agg(F.sum(hit).alias("hit"), F.sum("fact.weight").alias("all"), F.count("fact.pattern").alias("n"))
    return summed.select(*keys, F.when(F.col("n") == 0, 1.0).otherwise(ratio(F.col("hit"), F.col("all"))).alias("fact_score"))


def _yaml_documents(response: str) -> tuple[list, bool]:
    import yaml

    fast = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    out, sound = [], True
    for block in re.findall(r"```(?:ya?ml)\n(.*?)```", response, re.S):
        try:
            out += list(yaml.load_all(block, fast))
            continue
        except yaml.YAMLError:  # what libyaml refuses is judged by the plain loader
            pass
        try:
            for doc in yaml.safe_load_all(block):
                out.append(doc)
        except yaml.YAMLError:
            sound = False
    return [d for d in out if isinstance(d, dict)], sound


def check_structure(kind: str, documents: tuple[list, bool], expected: str | None, field: str | None) -> bool:
    """One structural check of a response's YAML documents (and whether all were sound); unknown kinds fail."""
    docs, sound = documents
    if kind == "no_yaml_errors":
        return sound
    if kind in ("api_version", "kind"):
        return any(d.get({"api_version": "apiVersion", "kind": "kind"}[kind]) == (expected or "") for d in docs)
    if kind != "required_field":
        return False

    def has(doc, parts) -> bool:
        return not parts or isinstance(doc, dict) and parts[0] in doc and has(doc[parts[0]], parts[1:])

    return any(has(d, (field or "").split(".")) for d in docs)


def has_code_block(response: Column) -> Column:
    return F.regexp_like(response, F.lit(r"(?Us)```\w*\n.*?```"))


def structure_scores(responses: DataFrame, checks: DataFrame, *keys: str) -> DataFrame:
    """checks: task_id, type, expected, field. Share of the task's checks that pass; 1 for a task without any.

    A task's checks come to a response together, so that its YAML is parsed once; the check for a code block is native.
    """

    @F.pandas_udf("int")
    def passing(response: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for r, own in zip(response, asked):
            documents = _yaml_documents(r or "") if own is not None and len(own) else None
            out.append(sum(check_structure(c["type"], documents, c["expected"], c["field"]) for c in own) if documents else 0)
        return pd.Series(out)

    fenced = F.when(F.contains("response", F.lit("```y")), F.col("response"))  # others have no YAML
    block = F.col("type") == "contains_code_block"
    asked = checks.where("type IS NOT NULL").groupBy("task_id").agg(F.count_if(block).alias("blocks"), F.collect_list(F.when(~block, F.struct("type", "expected", "field"))).alias("others"))
    tested = responses.join(F.broadcast(asked), "task_id", "left")  # responses stay where they are
    code = F.when(has_code_block(F.coalesce("response", F.lit(""))), F.col("blocks")).otherwise(F.lit(0))
    passed = tested.withColumns({"passed": code + F.when(F.size("others") > 0, passing(fenced, "others")).otherwise(0), "asked": F.col("blocks") + F.size("others")})
    return passed.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum("passed").cast("double"), F.sum("asked").cast("double")), F.lit(1.0)).alias("structure_score"))


def judge_answer(raw: Column) -> tuple[Column, Column]:
    """Score 1 to 5 and reasoning of a judge's JSON answer, fenced or not; nulls for any other."""
    bare = F.regexp_replace(F.trim(raw), r"(?s)\A```\w*\n|\n?```\z", "")
    got = F.from_json(bare, "struct<score:int,reasoning:string>")
    ok = got["score"].between(1, 5)
    return F.when(ok, got["score"]), F.when(ok, got["reasoning"])


def judge_median(answers: DataFrame, *keys: str) -> DataFrame:
    """answers: keys, call, score, reasoning. The whole part of the median, and the reasoning of the nearest call."""
    mid = answers.where("score IS NOT NULL").groupBy(*keys).agg(F.floor(F.median("score")).cast("int").alias("judge_score"))
    near = answers.where("score IS NOT NULL").join(mid, list(keys))
    return near.groupBy(*keys).agg(F.first("judge_score").alias("judge_score"), F.min_by("reasoning", F.struct(F.abs(F.col("score") - F.col("judge_score")), F.col("call"))).alias("judge_reasoning"))


def composite(fact: Column, structure: Column, judge: Column, weights: tuple[float, float, float] = (0.3, 0.3, 0.4)) -> Column:
    """Weighted quality; without a judge's score its weight is dealt to the other two."""
    f, s, j = weights
    base = F.lit(f) * fact + F.lit(s) * structure
    return F.when(judge.isNotNull(), base + F.lit(j) * (judge - 1) / 4).otherwise(base / (f + s) if f + s else F.lit(0.0))


def unfinished(scheduled: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What of a schedule has no result yet."""
    return scheduled.join(done.select(*keys), list(keys), "left_anti")
