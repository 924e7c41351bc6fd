"""Reading almost-JSON: one scanner that knows strings, numbers, names and separators, a cascade on top of it, and coercion
of whatever it reads. Plain Python on one text; `dirtyjson` gives the column functions, which run it on Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

TOKEN = re.compile(
    r"""(?P<gap>\s+|//[^\n]*|/\*.*?\*/)          # space and comments
    | (?P<text>"(?:[^"\\]|\\.)*")
    | (?P<quoted>'(?:[^'\\]|\\.|'(?=[A-Za-z]))*')  # an apostrophe before a letter is part of it
    | (?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    | (?P<name>-?[A-Za-z_]\w*)
    | (?P<mark>[][{}:,])
    | (?P<other>.)""",
    re.S | re.X,
)
# Names that stand for a JSON value.
NAMED = {"True": "true", "False": "false", "None": "null", "NaN": "null", "Infinity": "999999999", "-Infinity": "-999999999", "true": "true", "false": "false", "null": "null"}
CLOSER = {"{": "}", "[": "]"}
FENCE = "```"
# Fields that are read from a text that isn't JSON, what they are called there and the kind of their values.
WANTED = {"summary": ("summary", "text"), "description": ("description", "text"), "confidence": ("confidence", "number"), "score": ("confidence", "number")}
# Fields that hold an object's text, the first that is filled.
SAYING = ("description", "message", "text", "value", "reason", "content", "summary")
# Fields that hold an object's number, truth or score, the first that it has.
HOLDING = {"whole": ("value", "line", "number", "count"), "truth": ("value", "required", "enabled"), "score": ("score", "value", "confidence", "rating")}


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; comments are gone, single quotes are double ones, and what stays is as it was written."""
    out = []
    for found in TOKEN.finditer(text):
        kind, said = found.lastgroup, found.group()
        if kind == "gap":
            if not said.isspace():
                continue
        elif kind == "quoted":
            kind, said = "text", '"' + re.sub(r'(?<!\\)"', r'\\"', said[1:-1].replace("\\'", "'")) + '"'
        out.append((kind, said))
    return out


def repaired(text: str) -> str:
    """The text with faults mended inside of brackets and outside of strings: comments, quotes, bare names, Python's constants, numbers that JSON lacks,
    commas that are missing or left over, and pairs that stand in an array without braces. A blank text is an empty object."""
    if not text.strip():
        return "{}"
    found = tokens(text)
    solid = [i for i, (kind, _) in enumerate(found) if kind != "gap"]
    after = dict(zip(solid, solid[1:], strict=False))
    out: list[str] = []
    inside: list[str] = []
    last = ""  # what the last solid token was: value, mark or other
    for i, (kind, said) in enumerate(found):
        if kind == "gap":
            out.append(said)
            continue
        following = found[after[i]][1] if i in after else ""
        if said == "," and kind == "mark" and following in ("]", "}"):
            for k in range(i + 1, after[i]):  # the space after it goes too
                found[k] = ("gap", "")
            continue
        if kind == "name" and inside:
            said = f'"{said}"' if following == ":" else NAMED.get(said, said)
        starts = kind in ("text", "number", "name") or said in ("{", "[") and kind == "mark"
        if starts and last == "value" and inside:
            while out and out[-1].isspace():
                out.pop()
            out.append(", ")
        if starts and following == ":" and inside and inside[-1] == "[":
            inside[-1] = "pairs"
            out.append("{")
        if kind == "mark" and said in "{[":
            inside.append(said)
        elif kind == "mark" and said in "}]" and inside:
            if inside.pop() == "pairs" and said == "]":
                out.append("}")
        out.append(said)
        last = "value" if kind in ("text", "number", "name") or said in ("}", "]") and kind == "mark" else "mark" if kind == "mark" else "other"
    return "".join(out)


def closed(text: str) -> str:
    """The text with what closes its open braces, and then its open brackets; those inside of strings don't count."""
    marks = Counter(said for kind, said in tokens(text) if kind == "mark")
    ends = "".join(closer * (marks[opener] - marks[closer]) for opener, closer in CLOSER.items())
    return text.rstrip() + ends if ends else text


def unfenced(text: str) -> str:
    """The text inside a code fence, if it stands in one."""
    body = text.strip()
    if not body.startswith(FENCE):
        return body
    return body.removeprefix(FENCE).removeprefix("json").strip().removesuffix(FENCE).strip()


def fields(text: str) -> dict[str, Any] | None:
    """The fields of WANTED as far as the scanner can read them in a text that isn't JSON, the first of each; None if there is none.
    It goes by names that a colon and a whole value follow, wherever they stand."""
    out: dict[str, Any] = {}
    solid = [t for t in tokens(text) if t[0] != "gap"]
    for (named, name), (_, colon), (kind, said) in zip(solid, solid[1:], solid[2:], strict=False):
        field, wanted = WANTED.get(name[1:-1] if named == "text" else "", (None, None))
        if field and colon == ":" and kind == wanted and field not in out:
            out[field] = float(said) if kind == "number" else said[1:-1]  # a text as it was written
    return out or None


def strict(text: str) -> Any:
    """JSON's value; numbers that JSON lacks are read as `repaired` writes them. None if it is no JSON."""
    try:
        return json.loads(text, parse_constant=lambda name: json.loads(NAMED[name]))
    except (ValueError, RecursionError):
        return None


def parsed(text: str) -> Any:
    """The first of these that gives a value: the text, repaired, repaired and closed; the same of its braced part; its fields."""
    text = unfenced(text)
    if not text:
        return {}
    first, last = text.find("{"), text.rfind("}")
    for form in [text] + ([text[first : last + 1]] if 0 <= first < last else []):
        value = strict(form)
        if value is None:
            mended = repaired(form)
            value = strict(mended)
            if value is None:
                value = strict(closed(mended))
        if value is not None:
            return value
    return fields(text)


#: What a value of each kind is made of; a value of another kind is made of itself.
PARTS: dict[type, Callable[[Any], list]] = {
    type(None): lambda _: [], str: lambda v: [v] if v.strip() else [], list: lambda v: [x for x in v if x], dict: lambda v: [x for x in v.values() if x],
}


def parts(value: Any) -> list:
    return PARTS.get(type(value), lambda v: [v])(value)


def leaves(value: Any) -> Iterator[str]:
    """What a value says, in order: texts and numbers of lists and objects, but of an object only its first filled field of SAYING if it has one."""
    if isinstance(value, dict):
        said = [value[n] for n in SAYING if value.get(n)]
        value = said[:1] or value
    if isinstance(value, list | dict):
        for part in parts(value):
            yield from leaves(part)
    elif value is not None:
        yield str(value)


def as_text(value: Any) -> str:
    """Any value as one text: what it says, joined by spaces."""
    return " ".join(leaves(value))


def as_texts(value: Any) -> list[str]:
    """Any value as a list of texts, one for each part that it is made of; those that are empty go."""
    return [as_text(part) for part in parts(value)]


def held(value: Any, kind: str) -> Any:
    """The plain value that an object holds in the first field of HOLDING that it has, or that begins a list, however deep. A list has no truth."""
    match value:
        case dict():
            return next((held(value[n], kind) for n in HOLDING[kind] if n in value), None)
        case [first, *_] if kind != "truth":
            return held(first, kind)
        case list() if kind != "truth":
            return None
    return value


def as_whole(value: Any) -> int | None:
    """Any value as an integer, cut toward 0; None if it is none."""
    value = held(value, "whole")
    try:
        return int(value) if isinstance(value, (bool, int)) else None if value is None else int(float(value))
    except (ValueError, OverflowError):
        return None


def as_truth(value: Any, words: tuple[str, ...], default: bool = True) -> bool:
    """Any value as a boolean; the default if there is none."""
    value = held(value, "truth")
    if value is None or isinstance(value, list):
        return default
    return value.lower().strip() in words if isinstance(value, str) else bool(value)


def as_score(value: Any, words: dict[str, float], default: float) -> float:
    """Any value as a score from 0 to 1; numbers above 1 are tenths."""
    value = held(value, "score")
    if value is None:
        return default
    if isinstance(value, str):
        said = value.lower().strip()
        try:
            value = words[said] if said in words else float(said)
        except ValueError:
            return default
    value = float(value)
    return max(0.0, min(1.0, value / 10 if value > 1 else value))


def as_refs(value: Any, kinds: tuple[str, ...]) -> list[tuple[str, int | None, str]]:
    """(component_id, line, call_type) of references that are objects or plain ids: blank ids go, lines below 1 are unknown, other types direct."""
    out = []
    for ref in value if isinstance(value, list) else [value] if value else []:
        if not isinstance(ref, (dict, str)):
            continue
        name, line, kind = (ref.get("component_id"), as_whole(ref.get("call_site_line")), ref.get("call_type")) if isinstance(ref, dict) else (ref, None, None)
        if isinstance(name, dict):
            name = name.get("id") or name.get("name") or name.get("component_id")
        name = "" if name is None else str(name).strip()
        kind = as_text(kind).lower()
        if name:
            out.append((name, line if line is not None and line >= 1 else None, kind if kind in kinds else "direct"))
    return out
