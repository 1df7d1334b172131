"""Events in program logs: a fold over the lines with a stack of running programs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import base64_strict, from_base64

LINE, DATA = "Program ", "Program data: "
FOUND = "array<struct<program_id:string,data:binary,line:int>>"


def log_events(logs: Column | str) -> Column:
    """array<struct<program_id, data, line>> of the lines that carry base64 data, each with the program on top of the stack ('' if none). Without a UDF.

    A line `Program P invoke...` pushes P; `Program P success...` and `Program P failed...` pop, whatever P is; nothing else moves the stack,
    and unbalanced logs are not repaired. Null logs give null."""
    logs = F.col(logs) if isinstance(logs, str) else logs
    rest = F.transform(logs, _parsed)
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(FOUND).alias("out"), F.lit(0).alias("line"))

    def step(s: Column, x: Column) -> Column:
        stack = F.when(x["move"] == "push", F.array_append(s["stack"], x["program"])).when(x["move"] == "pop", F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        return F.struct(stack.cast("array<string>").alias("stack"), s["out"].alias("out"), s["line"].alias("line"))

    def note(s: Column, x: Column) -> Column:
        moved = step(s, x)
        one = F.struct(F.coalesce(F.try_element_at(moved["stack"], F.lit(-1)), F.lit("")).alias("program_id"), x["data"].alias("data"), s["line"].alias("line"))
        return F.struct(moved["stack"].alias("stack"), F.when(x["data"].isNotNull(), F.array_append(s["out"], one)).otherwise(s["out"]).cast(FOUND).alias("out"), (s["line"] + 1).alias("line"))

    return F.aggregate(rest, start, note, lambda s: s["out"])


def _parsed(line: Column) -> Column:
    """struct<move, program, data> of a line."""
    tail = F.substring(line, len(LINE) + 1, 1 << 30)
    gap = F.locate(" ", tail)
    after = F.substr(tail, gap + 1)
    ours = line.startswith(LINE) & (gap > 0)
    move = F.when(ours & after.startswith("invoke"), "push").when(ours & (after.startswith("success") | after.startswith("failed")), "pop").otherwise("")
    text = F.regexp_replace(F.substring(line, len(DATA) + 1, 1 << 30), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")
    return F.struct(move.alias("move"), F.when(gap > 0, F.substr(tail, F.lit(1), gap - 1)).otherwise("").alias("program"), F.when(line.startswith(DATA), from_base64(text)).alias("data"))


def read_log(lines: list[str | None]) -> list[dict]:
    """The same for one log, in Python."""
    stack: list[str] = []
    out = []
    for i, line in enumerate(lines):
        if line is None:
            continue
        if line.startswith(LINE):
            program, gap, rest = line[len(LINE) :].partition(" ")
            if gap and rest.startswith("invoke"):
                stack.append(program)
            elif gap and rest.startswith(("success", "failed")) and stack:
                stack.pop()
        if line.startswith(DATA) and (data := base64_strict(line[len(DATA) :].strip())) is not None:
            out.append({"program_id": stack[-1] if stack else "", "data": data, "line": i})
    return out


def log_events_fast(logs: Column | str) -> Column:
    """log_events() as one Arrow function: for logs of thousands of lines, where arrays that grow in a fold cost the square."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else read_log(x) for x in column.to_pylist()], pa.list_(pa.struct([("program_id", pa.string()), ("data", pa.binary()), ("line", pa.int32())])))

    return F.arrow_udf(run, FOUND)(logs)
