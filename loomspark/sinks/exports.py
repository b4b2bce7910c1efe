"""Training formats as DataFrames of nested columns, and their JSON files.

Every format is a projection; writing them is one pass. Files of one part are written by the executors as one
task where a single file is asked for.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_PROMPT = "You are a helpful assistant."
TOOL_PROMPT = "You are a helpful assistant that can call tools."


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def chat_messages(system_prompt: str = SYSTEM_PROMPT) -> Column:
    return F.array(message("system", F.lit(system_prompt)), message("user", F.col("instruction")), message("assistant", F.col("output")))


def record(row: DataFrame) -> DataFrame:
    """Examples in their wire form: empty lists and nulls are left out by the JSON writer."""
    chunks = F.when(F.size("source_chunks") > 0, F.col("source_chunks"))
    wanted = [c for c in ("instruction", "output", "judge_score", "judge_reason", "hallucination_score", "format", "metadata") if c in row.columns]
    return row.select(*wanted, chunks.alias("source_chunks"))


def sft(rows: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    return rows.select(chat_messages(system_prompt).alias("messages"))


def sft_rows(rows: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """messages with format and source chunks."""
    return rows.select(chat_messages(system_prompt).alias("messages"), F.lit("sft").alias("format"), "source_chunks")


def multiturn_rows(dialogues: DataFrame) -> DataFrame:
    return dialogues.select("messages", F.lit("multiturn").alias("format"), "source_chunks")


def preferences(pairs: DataFrame) -> DataFrame:
    return pairs.select("instruction", "chosen", "rejected", "chosen_score", "rejected_score", "source_chunks", F.lit("dpo").alias("format"))


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("instruction", "output")


def dataset_columns(rows: DataFrame) -> DataFrame:
    return rows.select("instruction", "output", "source_chunks", F.coalesce("judge_score", F.lit(-1)).alias("judge_score"))


def dialogues(rows: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """Multi-turn messages, a system message first if given; source chunks only where there are some."""
    lead = F.array(message("system", F.lit(system_prompt))) if system_prompt else None
    messages = F.col("messages") if lead is None else F.concat(lead, F.transform("messages", lambda m: message(m.role, m.content)))
    return rows.select(messages.alias("messages"), F.when(F.size("source_chunks") > 0, F.col("source_chunks")).alias("source_chunks"))


def tool_calls(rows: DataFrame, tool_schema: dict | None = None, system_prompt: str = TOOL_PROMPT) -> DataFrame:
    """Rows whose metadata (a VARIANT) name a tool call with arguments, as system, user, call and tool messages.

    The call's number is a checksum of instruction and name, so it is the same in every run.
    """
    call = F.try_variant_get("metadata", "$.tool_call", "variant")
    name = F.btrim(F.try_variant_get("metadata", "$.tool_call.name", "string"), F.lit(" \n\t"))
    arguments = F.try_variant_get("metadata", "$.tool_call.arguments", "variant")
    kind = F.schema_of_variant(arguments)
    text = F.when(kind == "STRING", F.try_variant_get(arguments, "$", "string")).when(kind.startswith("OBJECT"), F.to_json(arguments))
    good = rows.where(F.coalesce(F.schema_of_variant(call).startswith("OBJECT"), F.lit(False)) & (F.coalesce(name, F.lit("")) != "") & text.isNotNull())
    number = F.format_string("call_%08d", F.pmod(F.crc32(F.concat_ws("\x1f", "instruction", name).cast("binary")), F.lit(100_000_000)))

    def said(role: str, content: Column, calls: Column | None = None, of: Column | None = None, who: Column | None = None) -> Column:
        none = F.lit(None)
        calls_type = "array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>"
        return F.struct(
            F.lit(role).alias("role"), content.cast("string").alias("content"), (none if calls is None else calls).cast(calls_type).alias("tool_calls"),
            (none if of is None else of).cast("string").alias("tool_call_id"), (none if who is None else who).cast("string").alias("name"),
        )

    made = F.array(F.struct(number.alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), text.alias("arguments")).alias("function")))
    messages = F.array(said("system", F.lit(system_prompt)), said("user", F.col("instruction")), said("assistant", F.lit(None), made), said("tool", F.col("output"), of=number, who=name))
    out = good.select(messages.alias("messages"))
    if tool_schema is not None:
        out = out.withColumn("tools", F.array(F.struct(F.lit("function").alias("type"), F.parse_json(F.lit(json.dumps(tool_schema))).alias("function"))))
    return out


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def tool_lines(rows: DataFrame) -> DataFrame:
    """Tool-call rows as JSON lines: a call's content is an explicit null, other missing fields are left out."""
    whole = F.to_json(F.struct("*"))
    return rows.select(F.replace(whole, F.lit('{"role":"assistant","tool_calls"'), F.lit('{"role":"assistant","content":null,"tool_calls"')).alias("value"))


def write_lines(rows: DataFrame, path: str, one_file: bool = False) -> int:
    """JSON lines below a folder (or one part there); the number of lines."""
    return _write_text(_lines(rows), path, one_file)


def _write_text(lines: DataFrame, path: str, one_file: bool) -> int:
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path).count()


def write_tool_lines(rows: DataFrame, path: str, one_file: bool = False) -> int:
    return _write_text(tool_lines(rows), path, one_file)


def write_array(rows: DataFrame, path: str) -> int:
    """One local JSON file holding an array; rows stream through the driver one partition at a time."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in _lines(rows).toLocalIterator():
            f.write((",\n" if n else "\n") + row["value"])
            n += 1
        f.write("\n]\n")
    return n


def write_columns(rows: DataFrame, path: str) -> None:
    dataset_columns(rows).write.mode("overwrite").parquet(path)


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
