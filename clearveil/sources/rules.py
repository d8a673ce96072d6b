"""Rule files: JSON lists and YAML configurations, refused as a whole if any rule would match nothing or everything."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from clearveil.functions.text import CLASS_PATTERNS, _normal

#: Fixed value: sections of a YAML configuration that are known; only two of them are rules here.
KNOWN_SECTIONS = ("entity_types", "exact_values", "patterns", "backend", "model", "llm_url", "ollama_url", "scrub_metadata")


class RuleError(ValueError):
    pass


class Rule(NamedTuple):
    name: str
    kind: str  # value, pattern, class
    text: str  # the value's normal form, the expression, or the class
    flags: str = ""  # of the expression, in Java's notation
    strict: bool = False


class Rules(NamedTuple):
    rules: tuple[Rule, ...]
    warnings: tuple[str, ...] = ()

    def values(self) -> list[tuple[str, str]]:
        return [(r.name, r.text) for r in self.rules if r.kind == "value"]

    def informational(self, strict_classes: bool = False) -> set[str]:
        """Class rules that are notices unless they, or all, are strict."""
        return {r.name for r in self.rules if r.kind == "class" and not (r.strict or strict_classes)}


def _value(name: str, value: str) -> Rule:
    norm = _normal(value)
    if not norm:
        raise RuleError(f"{name}: the value has no letter or digit")
    return Rule(name, "value", norm)


def _pattern(name: str, source: str, flags: str) -> Rule:
    try:
        found = re.compile(source)
    except re.error as e:
        raise RuleError(f"{name}: {e}") from e
    if found.match(""):
        raise RuleError(f"{name}: the pattern matches the empty string")
    if re.search(r"\(\?P[<=>]|\(\?\(", source):
        raise RuleError(f"{name}: named groups and conditionals are not supported")
    return Rule(name, "pattern", source, flags)


def from_json(text: str) -> Rules:
    """A list of objects: a name, exactly one of value, pattern and class, and strict for a class."""
    try:
        rows = json.loads(text)
    except ValueError as e:
        raise RuleError(str(e)) from e
    if not isinstance(rows, list) or not rows:
        raise RuleError("a list of rules is needed")
    out: dict[str, Rule] = {}
    for row in rows:
        if not isinstance(row, dict) or not isinstance(row.get("name"), str) or not row["name"]:
            raise RuleError("every rule needs a name")
        name, kinds = row["name"], [k for k in ("value", "pattern", "class") if k in row]
        if name in out:
            raise RuleError(f"{name}: the name occurs twice")
        if len(kinds) != 1 or not isinstance(row[kinds[0]], str):
            raise RuleError(f"{name}: one of value, pattern and class is needed, as a string")
        if "strict" in row and (kinds != ["class"] or not isinstance(row["strict"], bool)):
            raise RuleError(f"{name}: strict is a boolean of class rules")
        text_ = row[kinds[0]]
        if kinds == ["class"]:
            if text_ not in CLASS_PATTERNS:
                raise RuleError(f"{name}: no such class")
            out[name] = Rule(name, "class", text_, strict=row.get("strict", False))
        else:
            out[name] = _value(name, text_) if kinds == ["value"] else _pattern(name, text_, "mU")
    return Rules(tuple(out.values()))


def from_yaml(text: str) -> Rules:
    """Lists exact_values and patterns of literal strings; unknown sections are warned of."""
    import yaml

    class Loader(yaml.BaseLoader):  # scalars stay as they are written
        pass

    def unique(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        if len(keys) != len(set(map(str, keys))):
            raise RuleError("a key occurs twice")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, unique)
    try:
        config = yaml.load(text, Loader)  # noqa: S506  it builds strings, lists and maps only
    except yaml.YAMLError as e:
        raise RuleError(str(e)) from e
    if not isinstance(config, dict):
        raise RuleError("a mapping is needed")
    out, warnings = [], [f"unknown section: {k}" for k in config if k not in KNOWN_SECTIONS]
    for section, make in (("exact_values", _value), ("patterns", lambda n, s: _pattern(n, s, "iuU"))):
        rows = config.get(section) or []
        if not isinstance(rows, list) or not all(isinstance(r, str) for r in rows):
            raise RuleError(f"{section}: a list of strings is needed")
        out += [make(f"{section}[{i}]", r) for i, r in enumerate(rows)]
    if not out:
        raise RuleError("there is no rule")
    return Rules(tuple(out), tuple(warnings))
