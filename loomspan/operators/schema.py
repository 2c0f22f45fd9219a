"""Records against a schema of nested types, bounds and required fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

_TEXT, _FILLED = {"type": "string"}, {"type": "string", "minLength": 1}


def _object(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "required": required, "properties": properties}


_WHOLE, _NUMBER = {"type": "integer"}, {"type": "number"}

#: The schemas of samples, results, facts and descriptions of runs.
SCHEMAS: dict[str, dict] = {
    "sample": _object(
        ["id", "task", "question", "documents", "answer"],
        id=_FILLED, task={"type": "string", "enum": ["single_doc_qa", "multi_doc_qa", "code_qa"]}, question=_FILLED, answer=_TEXT,
        documents={"type": "array", "minItems": 1, "items": _object(["doc_id", "text"], doc_id=_FILLED, text=_FILLED)},
    ),
    "result": _object(
        ["id", "pred", "gold", "n_steps", "n_retrieval", "latency_ms"],
        id=_TEXT, pred=_TEXT, gold=_TEXT, n_steps={"type": "integer", "minimum": 1}, n_retrieval={"type": "integer", "minimum": 0}, latency_ms=_object(["total"], total=_NUMBER), backend_mode={"type": "string", "enum": ["real", "mock", "unknown"]},
    ),
    "fact": _object(
        ["fact_id", "type", "content", "evidence", "confidence"],
        fact_id=_FILLED, type={"type": "string", "enum": ["entity", "relation", "constraint", "code_symbol", "summary"]}, content=_FILLED, evidence=_object(["doc_id", "chunk_id"], doc_id=_FILLED, chunk_id=_FILLED), confidence={"type": "number", "minimum": 0.0, "maximum": 1.0},
    ),
    "run_metadata": _object(
        ["run_id", "timestamp_utc", "git_commit", "config_paths", "model_info", "hardware", "seeds"],
        run_id=_FILLED, timestamp_utc=_FILLED, git_commit=_TEXT, config_paths={"type": "array", "minItems": 1, "items": _TEXT},
        model_info=_object(["backend", "name_or_path", "quantization", "n_ctx", "n_gpu_layers"], backend=_TEXT, name_or_path=_TEXT, quantization=_TEXT, n_ctx=_WHOLE, n_gpu_layers=_WHOLE),
        hardware=_object([], gpu_name=_TEXT, gpu_mem_mb=_NUMBER, cpu=_TEXT, ram_gb=_NUMBER), seeds=_object(["python", "numpy", "torch"], python=_WHOLE, numpy=_WHOLE, torch=_WHOLE),
    ),
}

_PYTHON = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool}
_SPARK = {"object": (D.StructType, D.MapType), "array": D.ArrayType, "string": D.StringType, "integer": D.IntegralType, "number": D.NumericType, "boolean": D.BooleanType}


def problems(record, schema: dict, path: str = "") -> list[str]:
    """Everything in a plain record that breaks a schema, as ``path: what``, in the schema's order. The root's path is ``.``."""
    at, kind, found = path or ".", schema.get("type"), []
    if kind and (not isinstance(record, _PYTHON[kind]) or (isinstance(record, bool) and kind != "boolean")):
        return [f"{at}: not of type {kind}"]
    if "enum" in schema and record not in schema["enum"]:
        found.append(f"{at}: not one of {len(schema['enum'])} values")
    if isinstance(record, str) and len(record) < schema.get("minLength", 0):
        found.append(f"{at}: shorter than {schema['minLength']}")
    if kind in ("integer", "number"):
        found += [f"{at}: below {schema['minimum']}"] if record < schema.get("minimum", record) else []
        found += [f"{at}: above {schema['maximum']}"] if record > schema.get("maximum", record) else []
    if kind == "object":
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in record]
        for k, own in schema.get("properties", {}).items():
            found += problems(record[k], own, f"{path}.{k}") if k in record else []
    if kind == "array":
        found += [f"{at}: fewer than {schema['minItems']} items"] if len(record) < schema.get("minItems", 0) else []
        for i, item in enumerate(record) if "items" in schema else []:
            found += problems(item, schema["items"], f"{path}[{i}]")
    return found


def require(record: dict, name: str) -> dict:
    """The record, or an error that names its first problem."""
    if found := problems(record, SCHEMAS[name]):
        raise ValueError(f"{name}: {found[0]}")
    return record


def violations(df: DataFrame, schema: dict) -> DataFrame:
    """Adds violations: what breaks the schema in each row, ``path: what`` joined by ';', in the schema's order.

    The walk over the schema is done once, into one expression. Columns and fields that are
    null or absent are missing if required, else nothing; one problem of a kind per array.
    """
    checks = []
    for name in schema["properties"]:
        if name in df.columns:
            checks += _checks(F.col(f"`{name}`"), df.schema[name].dataType, schema["properties"][name], f".{name}", name in schema.get("required", []))
        elif name in schema.get("required", []):
            checks.append((F.lit(True), f".{name}: missing"))
    listed = F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("violations", F.array_join(F.filter(listed, lambda x: x.isNotNull()), ";"))


def _checks(c: Column, kind: D.DataType, schema: dict, path: str, required: bool) -> list[tuple[Column, str]]:
    out = [(c.isNull(), f"{path}: missing")] if required else []
    if "type" in schema and not isinstance(kind, _SPARK[schema["type"]]):
        return [*out, (c.isNotNull(), f"{path}: not of type {schema['type']}")]
    if "enum" in schema:
        out.append((~c.isin(schema["enum"]), f"{path}: not one of {len(schema['enum'])} values"))
    if "minLength" in schema:
        out.append((F.length(c) < schema["minLength"], f"{path}: shorter than {schema['minLength']}"))
    if "minimum" in schema:
        out.append((c < schema["minimum"], f"{path}: below {schema['minimum']}"))
    if "maximum" in schema:
        out.append((c > schema["maximum"], f"{path}: above {schema['maximum']}"))
    if isinstance(kind, D.StructType):
        have = {f.name: f.dataType for f in kind.fields}
        for name, own in schema.get("properties", {}).items():
            needed = name in schema.get("required", [])
            if name in have:
                out += [(c.isNotNull() & bad, m) for bad, m in _checks(c[name], have[name], own, f"{path}.{name}", needed)]
            elif needed:
                out.append((c.isNotNull(), f"{path}.{name}: missing"))
    if isinstance(kind, D.ArrayType):
        if "minItems" in schema:
            out.append((F.size(c) < schema["minItems"], f"{path}: fewer than {schema['minItems']} items"))
        if "items" in schema:
            messages = [m for _, m in _checks(F.lit(None), kind.elementType, schema["items"], f"{path}[]", True)]
            out += [(F.exists(c, _item_check(kind.elementType, schema["items"], i)), m) for i, m in enumerate(messages)]
    return out


def _item_check(kind: D.DataType, schema: dict, number: int) -> Callable[[Column], Column]:
    """The check of that number of an array's items."""
    return lambda x: F.coalesce(_checks(x, kind, schema, "", True)[number][0], F.lit(False))
