"""Segments of prompts, and what models return: parsing, repair, merging, absorbing."""

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import values as V
from slotweave.operators.skew import lookup

SEGMENTS = "struct<segments:array<struct<span_text:string,taxonomy_label:string,level:string>>>"


def merged_adjacent(segments: DataFrame) -> DataFrame:
    """(prompt_id, seg_idx, label, span_text): neighbouring segments of one label become one, texts joined by a blank."""
    w = W.partitionBy("prompt_id").orderBy("seg_idx")
    run = F.sum(F.when(F.col("label").eqNullSafe(F.lag("label").over(w)) & F.lag("seg_idx").over(w).isNotNull(), 0).otherwise(1)).over(w)
    g = segments.withColumn("_run", run).groupBy("prompt_id", "_run").agg(
        F.min("seg_idx").alias("seg_idx"), F.min_by("label", "seg_idx").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "span_text"))), lambda x: x["span_text"]), " ").alias("span_text")
    )
    return g.drop("_run")


def absorbed_context(segments: DataFrame) -> DataFrame:
    """(prompt_id, seg_idx, label, level, span_text): where a prompt has exactly one real task among its task segments, its
    context segments (information extraction, description, explanation) go into that task: all spans in order if every
    segment is a task, else after the task's own span. Other prompts and segments stay as they are."""
    w = W.partitionBy("prompt_id")
    task = F.col("level") == "task_type"
    context = task & F.col("label").isin(*V.CONTEXT_LABELS)
    real = task & ~context
    s = segments.withColumn("_context", context).withColumn("_real", real).withColumn("_n", F.count_if(real).over(w)).withColumn("_all", F.count_if(~task).over(w) == 0)
    s = s.withColumn("_first", F.min(F.when(real, F.col("seg_idx"))).over(w))
    into = F.when(F.col("_context") & (F.col("_first").isNotNull()) & (~F.col("_all") | (F.col("_n") == 1)), F.col("_first")).otherwise(F.col("seg_idx"))
    order = F.when(F.col("_all"), F.col("seg_idx")).otherwise(F.when(F.col("seg_idx") == into, -1).otherwise(F.col("seg_idx")))
    g = s.withColumn("_into", into).withColumn("_order", order).groupBy("prompt_id", F.col("_into").alias("seg_idx")).agg(
        F.min_by("label", F.abs(F.col("seg_idx") - F.col("_into"))).alias("label"), F.min_by("level", F.abs(F.col("seg_idx") - F.col("_into"))).alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "span_text"))), lambda x: x["span_text"]), " ").alias("span_text"),
    )
    return g


def parsed_segments(replies: DataFrame, leaves: DataFrame) -> DataFrame:
    """(prompt_id, seg_idx, span_text, label, level, method) from model replies (prompt_id, reply): a label the taxonomy
    lacks becomes 'description' (llm_invalid); a reply that is no JSON even after repair becomes one segment (llm_failed)."""
    clean = F.regexp_replace(F.regexp_replace("reply", r"(?s)<think>.*?</think>", ""), r"(?m)^\s*```\w*\s*$", "")
    direct = replies.withColumn("_s", F.from_json(clean, SEGMENTS)["segments"])
    fixed = direct.withColumn("_s", F.coalesce("_s", F.from_json(repair(F.when(F.col("_s").isNull(), F.col("reply"))), SEGMENTS)["segments"]))
    x = fixed.select("prompt_id", "reply", F.posexplode_outer("_s").alias("seg_idx", "s"))
    known = leaves.select(F.col("label").alias("_label"), F.col("level").alias("_level")).dropDuplicates(["_label"])
    ok = x.join(F.broadcast(known), F.col("s.taxonomy_label") == F.col("_label"), "left")
    method = F.when(F.col("s").isNull(), "llm_failed").when(F.col("_label").isNull(), "llm_invalid").otherwise("llm")
    return ok.select("prompt_id", F.coalesce("seg_idx", F.lit(0)).alias("seg_idx"), F.coalesce("s.span_text", "reply").alias("span_text"), F.coalesce("_label", F.lit("description")).alias("label"), F.coalesce("_level", F.lit("task_type")).alias("level"), method.alias("method"))


def with_source(segments: DataFrame, prompts: DataFrame, order: str) -> DataFrame:
    """segments (source_prompt) with the source of their prompt: prompts has source_prompt and source; of equal prompts the
    last in order counts, segments of unknown prompts get null."""
    last = prompts.groupBy("source_prompt").agg(F.max_by("source", order).alias("source"))
    return lookup(segments, last, ["source_prompt"], F.monotonically_increasing_id(), "left")


def repaired(text: str) -> str | None:
    """The JSON object in a model's reply, as strict JSON; null if there is none. Takes out thinking and fences, finds the
    outermost object, mends quotes, bare keys, trailing commas and control characters, and closes what was cut off."""
    if text is None:
        return None
    s = re.sub(r"(?s)<think>.*?(?:</think>|$)", "", text)
    s = re.sub(r"```\w*", "", s).strip()
    for candidate in _candidates(s):
        for fix in (lambda x: x, _mended, lambda x: _closed(_mended(x)), _closed):
            try:
                return json.dumps(json.loads(fix(candidate)), ensure_ascii=False)
            except (ValueError, RecursionError):
                continue
    return None


def _candidates(s: str) -> Iterator[str]:
    yield s
    start = s.find("{")
    if start < 0:
        return
    depth, quoted, i = 0, False, start
    while i < len(s):
        c = s[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                yield s[start : i + 1]
                break
        i += 1
    yield s[start:]


def _mended(s: str) -> str:
    s = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", s)
    s = re.sub(r"'([A-Za-z_]\w*)'\s*:", r'"\1":', s)
    s = re.sub(r":\s*'([^'\n]*)'", lambda m: ": " + json.dumps(m.group(1)), s)
    s = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s)
    return re.sub(r",\s*([\]}])", r"\1", s)


def _closed(s: str) -> str:
    out, stack, quoted, i = [], [], False, 0
    while i < len(s):
        c = s[i]
        if quoted and c == "\\":
            out.append(s[i : i + 2])
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            stack.append("]" if c == "[" else "}")
        elif not quoted and c in "]}" and stack:
            stack.pop()
        out.append("\\n" if quoted and c == "\n" else c)
        i += 1
    tail = '"' if quoted else ""
    return re.sub(r"[,:]\s*$", lambda m: ": null" if m.group()[0] == ":" else "", "".join(out) + tail) + "".join(reversed(stack))


def repair(reply: Column) -> Column:
    """repaired() as a column function; Arrow batches."""
    return F.pandas_udf(lambda xs: xs.map(repaired), T.StringType())(reply)


def few_shot_fixed(templates: DataFrame) -> DataFrame:
    """{n} becomes {number} in text and slots; some wordings set the level."""
    text = F.replace(F.col("text"), F.lit("{n}"), F.lit("{number}"))
    #: Wordings that are format constraints.
    formats = ("and in all capital letters", "should appear {number} or more times in your response", "Include {metric} in {unit}.")
    level = F.when(F.lit(False), F.lit(""))
    for x in formats:
        level = level.when(F.contains(text, F.lit(x)), "format_constraint")
    return templates.withColumn("level", level.otherwise(F.col("level"))).withColumn("slots", F.transform("slots", lambda s: F.when(s == "n", "number").otherwise(s))).withColumn("text", text)
