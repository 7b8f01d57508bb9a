"""Functions that need Python, as Arrow UDFs and table functions, and their SQL names."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import PandasUDFType, pandas_udf, udtf


def chunk_text(text: str, size: int = 3000, overlap: int = 500) -> list[str]:
    """Overlapping chunks that end after a full stop or line end in their second half where there is one.

    ``overlap`` must be at most half of ``size``, so that every chunk goes on from the one before.
    """
    if not 0 <= overlap <= size // 2:
        raise ValueError("need 0 <= overlap <= size // 2")
    # where a chunk may end, and the end of the text behind them all
    stops = [m.end() for m in re.finditer("[。\n]", text)]
    bounds = [(0, 0)] if text else []
    while bounds and bounds[-1][1] < len(text):
        first = bounds[-1][1] - overlap if bounds[-1][1] else 0
        last = min(first + size, len(text))
        near = bisect_right(stops, last) - 1
        if last < len(text) and near >= 0 and stops[near] > first + size // 2:
            last = stops[near]
        bounds.append((first, last))
    return [text[a:b] for a, b in bounds[1:]]


def repair_json(text: str | None) -> str | None:
    """Canonical JSON of the first object or array in a model's answer; null if none can be read.

    Fences and thinking tags go, trailing commas go, and what a cut-off answer left open is closed.
    """
    if not text:
        return None
    body = re.sub(r"<think>.*?</think>", "", text, flags=re.S)
    body = re.sub(r"```(?:json)?", "", body)
    at = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    body = body[at:]
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
    except ValueError:
        value = _closed(body)
        if value is None:
            return None
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _closed(body: str):
    """The longest start of ``body`` that is JSON once its open strings and brackets are closed.

    Commas before a closing bracket go first. A start that fails at some place rules out all longer ones that hold that
    place, so that few starts are tried.
    """
    body = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', r"\1", body, flags=re.S)
    stack, inside, escaped, cuts = [], False, False, []
    for i, c in enumerate(body):
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
                cuts.append((i + 1, "".join(reversed(stack))))
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            cuts.append((i + 1, "".join(reversed(stack))))
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
            cuts.append((i + 1, "".join(reversed(stack))))
            if not stack:
                break
        elif c == ",":
            cuts.append((i, "".join(reversed(stack))))
    if inside and (value := _loaded(body + '"' + "".join(reversed(stack))))[0]:
        return value[1]
    most = len(body)
    for n, closing in reversed(cuts):
        if n > most:
            continue
        ok, value = _loaded(body[:n].rstrip().rstrip(",") + closing)
        if ok:
            return value
        most = min(n - 1, value)
    return None


def _loaded(text: str) -> tuple[bool, object]:
    """(True, value), or (False, where reading failed)."""
    try:
        return True, json.loads(text)
    except json.JSONDecodeError as e:
        return False, e.pos
    except (ValueError, RecursionError):
        return False, len(text)


def register(spark: SparkSession) -> None:
    """SQL names: evoria_repair_json(text), and the table functions evoria_chunks(text, size, overlap)."""
    @pandas_udf("string", PandasUDFType.SCALAR)
    def repair(s):
        return s.map(repair_json)

    @udtf(returnType="chunk_no: int, body: string")
    class Chunks:
        def eval(self, text: str, size: int, overlap: int) -> Iterator:
            for i, c in enumerate(chunk_text(text or "", size, overlap)):
                yield i, c

    spark.udf.register("evoria_repair_json", repair)
    spark.udtf.register("evoria_chunks", Chunks)


def chunks_column(column, size: int = 3000, overlap: int = 500):
    @pandas_udf("array<string>", PandasUDFType.SCALAR)
    def run(s):
        return s.map(lambda t: chunk_text(t or "", size, overlap))

    return run(column)
