"""JSON-lines agent events to display text; the same columns serve batch and stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafaudit.functions.paths import base_name
from leafaudit.functions.text import strip

EVENT = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("type", "subtype", "model", "text", "message", "error")],
        T.StructField("tool_call", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
CONTENT = "struct<content:array<struct<type:string,text:string>>>"
CALL = "struct<args:map<string,string>>"
TOOL_TYPES = ["tool_call", "tool", "tool_use", "tool_result", "tool_output"]
TARGET_KEYS = ["path", "file", "target", "command"]


def _parse(line: Column) -> Column:
    return F.from_json(line, EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def _tool_label(ev: Column) -> Column:
    """Name, subtype and target of the first nested tool call."""
    sub = F.coalesce(ev["subtype"], F.lit("?"))
    calls = F.filter(
        F.map_entries(F.coalesce(ev["tool_call"], F.create_map().cast("map<string,string>"))),
        lambda e: F.lower(e["key"]).contains("toolcall") & e["value"].startswith("{"),
    )
    first = F.get(calls, F.lit(0))
    name = F.replace(F.replace(first["key"], F.lit("ToolCall"), F.lit("")), F.lit("toolcall"), F.lit(""))
    args_text = F.coalesce(F.get_json_object(first["value"], "$.args"), F.lit("{}"))
    args = F.from_json(first["value"], CALL)["args"]
    target = reduce(
        lambda acc, key: F.coalesce(acc, F.nullif(args[key], F.lit(""))), TARGET_KEYS, F.lit(None).cast("string")
    )
    extra = F.coalesce(base_name(F.rtrim(target, F.lit("/"))), F.left(args_text, F.lit(80)))
    full = F.concat(name, F.lit(" ("), sub, F.lit(")"), F.when(extra != "", F.concat(F.lit(": "), extra)).otherwise(""))
    return F.when(first.isNotNull(), full).otherwise(F.concat(F.lit("tool ("), sub, F.lit(")")))


def _display(ev: Column, line: Column) -> Column:
    kind, sub = ev["type"], ev["subtype"]
    blocks = F.filter(
        F.from_json(ev["message"], CONTENT)["content"], lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)
    )
    said = F.array_join(F.transform(blocks, lambda b: b["text"]), "")
    label = _tool_label(ev)
    model = F.when(F.length(ev["model"]) > 0, F.concat(F.lit(" model="), ev["model"])).otherwise("")
    return (
        F.when((kind == "system") & (sub == "init"), F.concat(F.lit("[system] session started"), model))
        .when(kind == "system", F.concat(F.lit("[system] "), F.coalesce(F.nullif(sub, F.lit("")), kind)))
        .when((kind == "thinking") & (sub == "delta"), ev["text"])
        .when((kind == "thinking") & (sub == "completed"), F.lit("\n"))
        .when(kind == "assistant", said)
        .when(
            kind.isin(TOOL_TYPES),
            F.when(sub == "started", F.concat(F.lit("\n▶ "), label, F.lit("\n")))
            .when(sub == "completed", F.concat(F.lit("✓ "), label, F.lit("\n")))
            .otherwise(F.concat(F.lit("\n[tool] "), label, F.lit("\n"))),
        )
        .when(kind == "result", F.concat(F.lit("\n[result] "), F.coalesce(F.nullif(sub, F.lit("")), F.lit("done")), F.lit("\n")))
        .when(
            kind == "error",
            F.concat(
                F.lit("\n[error] "),
                F.coalesce(F.nullif(ev["message"], F.lit("")), F.nullif(ev["error"], F.lit("")), line),
                F.lit("\n"),
            ),
        )
    )


def agent_event_decode(events: DataFrame, line: str = "line") -> DataFrame:
    """Add chunk; malformed lines pass through, user events and empty text are dropped."""
    raw = strip(F.col(line))
    staged = events.withColumn("_raw", raw).filter("_raw <> ''").withColumn("_ev", _parse(F.col("_raw")))
    ev = F.col("_ev")
    broken = ev.isNull() | ev["_corrupt_record"].isNotNull() | ~F.col("_raw").endswith("}")
    chunk = F.when(broken, F.concat("_raw", F.lit("\n"))).otherwise(_display(ev, F.col("_raw")))
    return staged.withColumn("chunk", chunk).filter(F.length("chunk") > 0).drop("_raw", "_ev")
