"""Rule checks on answers that need a parser: instruction constraints, embedded JSON, arithmetic, marked-up chats.

Each is a plain function on one text with a vectorised wrapper for Arrow batches.
"""

from __future__ import annotations

import ast
import json
import operator
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_COUNT = re.compile(
    r"(?:(at least|no fewer than|no less than|at most|no more than|fewer than|less than|more than|over|exactly|precisely)\s+)?(\d+|" + "|".join(_NUMBERS) + r")\s+(?:\w+\s+)?(word|sentence|paragraph|bullet|item|line|section|placeholder|letter)s?\b", re.I
)


def requirement(text: str | None) -> dict | None:
    """``kind, low, high`` of the first counted requirement in an instruction; an open side is null."""
    found = _COUNT.search(text or "")
    if not found:
        return None
    n = int(found[2]) if found[2].isdigit() else _NUMBERS[found[2].lower()]
    how = (found[1] or "exactly").lower()
    low, high = {
        "at least": (n, None), "no fewer than": (n, None), "no less than": (n, None), "more than": (n + 1, None), "over": (n + 1, None),
        "at most": (None, n), "no more than": (None, n), "fewer than": (None, n - 1), "less than": (None, n - 1),
    }.get(how, (n, n))
    return {"kind": found[3].lower(), "low": low, "high": high}


def counted(kind: str, text: str) -> int:
    """How many words, sentences, paragraphs, bullets and so on an answer has."""
    if kind == "word":
        return len(re.findall(r"[\w'’-]+", text)) if text.isascii() else len(re.findall(r"[一-鿿]|[^\W_]+", text))
    if kind == "sentence":
        return len([s for s in re.split(r"[.!?。！？]+", text) if s.strip()])
    if kind in ("paragraph", "section"):
        return len([p for p in re.split(r"\n\s*\n|\n\s*\*{3}\s*\n", text) if p.strip()])
    if kind in ("bullet", "item"):
        return len(re.findall(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+", text))
    if kind == "line":
        return len([x for x in text.splitlines() if x.strip()])
    if kind == "placeholder":
        return len(re.findall(r"\[[^\[\]\n]+\]", text))
    return len(re.findall(r"[^\W\d_]", text))


def _json_ok(text: str) -> bool:
    try:
        json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text))
    except ValueError:
        return False
    return True


def _quoted(prompt: str) -> list[str]:
    return re.findall(r"[\"“']([^\"”']+)[\"”']", prompt)


#: Families of constraints: what in the instruction asks for it, and whether an answer keeps it.
CONSTRAINTS: dict[str, tuple[re.Pattern, Callable[[str, str], bool]]] = {
    "no_comma": (re.compile(r"\b(?:no|without|avoid|not use)\b[^.]{0,20}\bcommas?\b", re.I), lambda p, a: "," not in a and "，" not in a),
    "json": (re.compile(r"\b(?:as|in|valid|only)\b[^.]{0,12}\bjson\b", re.I), lambda p, a: _json_ok(a)),
    "upper": (re.compile(r"\b(?:all capital|capital letters|all caps|upper ?case)\b", re.I), lambda p, a: a == a.upper() and a != a.lower()),
    "lower": (re.compile(r"\b(?:all lower ?case|lower ?case letters|no capital)\b", re.I), lambda p, a: a == a.lower()),
    "title": (re.compile(r"<<|\btitle\b[^.]{0,20}(?:double angular|<<)", re.I), lambda p, a: bool(re.search(r"<<[^<>\n]+>>", a))),
    "quotation": (re.compile(r"\bwrap\b[^.]{0,40}\b(?:double )?quot", re.I), lambda p, a: len(a.strip()) > 1 and a.strip()[0] == a.strip()[-1] == '"'),
    "keywords": (re.compile(r"\binclude\b[^.]{0,20}\b(?:keywords?|words?|phrases?)\b", re.I), lambda p, a: all(q.lower() in a.lower() for q in _quoted(p))),
    "forbidden": (re.compile(r"\b(?:do not|don't|avoid|never)\b[^.]{0,20}\b(?:include|use|mention)\b[^.]{0,20}\b(?:keywords?|words?)\b", re.I), lambda p, a: not any(q.lower() in a.lower() for q in _quoted(p))),
    "ending": (re.compile(r"\b(?:end|finish)\b[^.]{0,30}\bwith\b[^.]{0,30}[\"“']", re.I), lambda p, a: any(a.strip().rstrip("\"'").endswith(q.rstrip("\"'")) for q in _quoted(p)[-1:])),
    "postscript": (re.compile(r"\bpostscript\b|\bp\.? ?s\.?\b", re.I), lambda p, a: bool(re.search(r"(?im)^\s*p\.? ?s\.?", a))),
    "placeholder": (re.compile(r"\bplaceholders?\b|square brackets", re.I), lambda p, a: counted("placeholder", a) > 0),
    "highlight": (re.compile(r"\bhighlight", re.I), lambda p, a: bool(re.search(r"\*[^*\n]+\*", a))),
    "two_responses": (re.compile(r"\btwo different (?:responses|answers)\b", re.I), lambda p, a: len([x for x in a.split("******") if x.strip()]) == 2),
    "repeat_prompt": (re.compile(r"\brepeat the (?:request|prompt|question)\b", re.I), lambda p, a: bool(p) and a.strip().startswith(p.strip().split("\n")[0])),
    "one_label": (re.compile(r"\bone (?:label|word) only\b|\bonly one word\b", re.I), lambda p, a: len(a.split()) == 1),
    "options": (re.compile(r"\banswer with (?:one of|exactly one of)\b|\bmy answer is (?:yes|no|maybe)\b", re.I), lambda p, a: any(q.lower() == a.strip().rstrip(".").lower() for q in _quoted(p)) or bool(re.search(r"my answer is (?:yes|no|maybe)", a, re.I))),
    "first_word": (re.compile(r"\b(?:first word|start(?:s)? with the word|begin with the word)\b", re.I), lambda p, a: any(a.strip().lower().startswith(q.lower()) for q in _quoted(p)[:1])),
    "letter_frequency": (re.compile(r"\bletter [\"“'](\w)[\"”'][^.]{0,40}\b(?:at least)\s+(\d+)", re.I), lambda p, a: (m := re.search(r"\bletter [\"“'](\w)[\"”'][^.]{0,40}\b(?:at least)\s+(\d+)", p, re.I)) is not None and a.lower().count(m[1].lower()) >= int(m[2])),
    "english": (re.compile(r"\b(?:in|entirely in) english\b", re.I), lambda p, a: not re.search(r"[一-鿿]", a)),
    "chinese": (re.compile(r"\bin chinese\b|用中文", re.I), lambda p, a: len(re.findall(r"[一-鿿]", a)) >= 5),
    "bullets": (re.compile(r"\bbullet points?\b", re.I), lambda p, a: _counts(p, a, {"bullet", "item"})),
    "counts": (_COUNT, lambda p, a: _counts(p, a, None)),
    "numbered": (re.compile(r"\bnumbered list\b", re.I), lambda p, a: bool(re.search(r"(?m)^\s*1[.)]\s", a))),
    "table": (re.compile(r"\b(?:as|in) a table\b", re.I), lambda p, a: bool(re.search(r"(?m)^\s*\|.+\|\s*$", a))),
    "code": (re.compile(r"\bcode block\b", re.I), lambda p, a: a.count("```") >= 2),
}


def _counts(prompt: str, answer: str, kinds: set[str] | None) -> bool:
    need = requirement(prompt)
    if need is None or (kinds is not None and need["kind"] not in kinds and need["kind"] != "line"):
        return counted("bullet", answer) > 0
    n = counted(need["kind"], answer)
    return (need["low"] is None or n >= need["low"]) and (need["high"] is None or n <= need["high"])


def verdict(prompt: str | None, answer: str | None) -> dict:
    """``status`` (pass, fail or none), the families asked for and those not kept."""
    p, a = prompt or "", answer or ""
    asked = [name for name, (ask, _) in CONSTRAINTS.items() if ask.search(p)]
    broken = [name for name in asked if not CONSTRAINTS[name][1](p, a)]
    return {"status": "none" if not asked else "fail" if broken or not a.strip() else "pass", "families": asked, "broken": broken}


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}


def arithmetic(text: str | None) -> float | None:
    """Value of an arithmetic expression, or None; only numbers and operators are evaluated."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow):  # in floating point: what has no finite value overflows at once
                a, b = float(a), float(b)
            return _OPS[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    try:
        if not text:
            return None
        return float(value(ast.parse(text.replace("^", "**").replace("×", "*").replace("÷", "/").strip(), mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError, MemoryError):
        return None


def embedded_json(text: str | None) -> list[str]:
    """Every JSON object that stands in free text, in canonical form; objects inside objects aren't listed again."""
    out, decoder, at = [], json.JSONDecoder(), 0
    while text and (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            out.append(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            at = end
        except (ValueError, RecursionError):
            at += 1
    return out


def canonical_json(text: str | None) -> str | None:
    """Sorted keys, no blanks, characters as they are; None if it isn't JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return None


def flattened(text: str | None) -> str:
    """All numbers in a nested record, as a JSON list of ``metric`` (the dotted path) and ``metric_value``."""
    found: list[dict] = []

    def walk(value, path: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]")
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            found.append({"metric": path, "metric_value": value})

    try:
        walk(json.loads(text), "")
    except (TypeError, ValueError, RecursionError):
        return "[]"
    return json.dumps(found)


def boxed(text: str | None) -> list[str] | None:
    """Reasoning and answer of a text that ends in a balanced ``\\boxed{...}``."""
    start = (text or "").rfind("\\boxed{")
    if start < 0:
        return None
    depth, at = 0, start + 6
    for at in range(start + 6, len(text)):
        depth += (text[at] == "{") - (text[at] == "}")
        if depth == 0:
            break
    if depth or text[at + 1 :].strip(" .$\n\\)]"):
        return None
    return [text[:start].strip(), text[start + 7 : at].strip()]


_MARKS = re.compile(r"(?m)^(USER|ASSISTANT|SYSTEM|FUNCTION RESPONSE):[ \t]*")


def marked_chat(text: str | None) -> list[dict]:
    """Messages of a chat with a marker before each."""
    parts = _MARKS.split(text or "")
    names = {"USER": "user", "ASSISTANT": "assistant", "SYSTEM": "system", "FUNCTION RESPONSE": "tool"}
    return [{"role": names[m], "content": c.replace("<|endoftext|>", "").strip()} for m, c in zip(parts[1::2], parts[2::2])]


def tool_argument_fault(call: str | None, schema: str | None) -> str | None:
    """First fault of a tool call against the tool's parameter schema: ``json``, ``required``, ``unknown``, ``type`` or ``bounds``."""
    try:
        arguments, spec = json.loads(call), json.loads(schema)
    except (TypeError, ValueError):
        return "json"
    if not isinstance(arguments, dict) or not isinstance(spec, dict):
        return "json"
    known = spec.get("properties", {})
    if not set(spec.get("required", [])) <= set(arguments):
        return "required"
    if not set(arguments) <= set(known):
        return "unknown"
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    for k, v in arguments.items():
        want = known[k].get("type") if isinstance(known[k], dict) else None
        if want in kinds and (not isinstance(v, kinds[want]) or (isinstance(v, bool) and want in ("integer", "number"))):
            return "type"
        if isinstance(v, (int, float)) and not known[k].get("minimum", v) <= v <= known[k].get("maximum", v):
            return "bounds"
    return None


def vectorised(fn: Callable, kind: T.DataType, *columns: Column | str) -> Column:
    """Run one of the functions above over Arrow batches."""
    if len(columns) == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return a.map(lambda x: fn(x))

        return one(*columns)

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b)], dtype=object)

    return two(*columns)
