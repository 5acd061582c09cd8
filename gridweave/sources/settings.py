"""Settings files: JSON, or the part of YAML that settings use."""

from __future__ import annotations

import json
import re


def _value(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[:1] == text[-1:] and len(text) > 1:
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    if low in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _yaml(text: str) -> dict:
    """Nested mappings by indentation, lists of scalars, comments; no anchors and no tags."""
    top: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, top)]
    owner: tuple[dict, str] | None = None
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare or bare.strip() in ("---", "..."):
            continue
        depth, bare = len(bare) - len(bare.lstrip()), bare.strip()
        if bare.startswith("- ") and owner is not None:
            if not isinstance(owner[0][owner[1]], list):
                owner[0][owner[1]] = []
            owner[0][owner[1]].append(_value(bare[2:]))
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key, _, rest = bare.partition(":")
        here = stack[-1][1]
        key = key.strip().strip("'\"")
        if rest.strip():
            here[key] = _value(rest)
        else:
            here[key] = inner = {}
            stack.append((depth, inner))
            owner = (here, key)
    return top


def read(text: str) -> dict:
    """The settings of a file; an empty file has none."""
    return json.loads(text) if text.lstrip().startswith("{") else _yaml(text)
