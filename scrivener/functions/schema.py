"""JSON Schema (draft 2020-12) compiled into one Column that lists what a VARIANT breaks."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scrivener.functions.text import bind

#: Keywords that only describe, besides those that ``_Compiler`` checks; any other is refused.
NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$anchor"}
CHECKED = {
    "$ref", "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems",
    "items", "prefixItems", "contains", "minContains", "maxContains", "properties", "patternProperties", "additionalProperties", "propertyNames", "required", "dependentRequired", "minProperties", "maxProperties",
    "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "object": ("OBJECT",), "array": ("ARRAY",), "number": _NUMBERS, "integer": _NUMBERS}
_ISSUES = "array<struct<path:string,rule:string>>"


def load_schema(spark: SparkSession, path: str) -> dict | bool:
    """A schema from a file that Spark can read; a missing or broken one raises a RuntimeError that names the path."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first().value)
    except Exception as e:
        raise RuntimeError(f"cannot read {path}: {e}") from e


def _none() -> Column:
    return F.array().cast(_ISSUES)


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _same(v: Column) -> Column:
    """Equal for equal JSON values; numbers by value at the top (1 is 1.0), within lists and objects as written."""
    return F.when(_kind(v).isin(*_NUMBERS), F.try_variant_get(v, "$", "double").cast("string")).otherwise(F.to_json(v))


def _literal(x: Any) -> Column:
    return _same(F.parse_json(F.lit(json.dumps(x, ensure_ascii=False))))


def _at(path: Column, key: Column) -> Column:
    return F.concat(path, F.lit("."), key)


def _place(path: Column, i: Column) -> Column:
    return F.concat(F.when(path == "$", F.lit("$.")).otherwise(path), F.lit("["), i.cast("string"), F.lit("]"))


class _Compiler:
    def __init__(self, root: Any, depth: int):
        self.root, self.depth = root, depth

    def resolve(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise ValueError(f"only references within the schema are read: {ref}")
        at = self.root
        for part in ref[1:].strip("/").split("/") if ref[1:].strip("/") else []:
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                at = at[int(part)] if isinstance(at, list) else at[part]
            except (KeyError, IndexError, ValueError):
                raise ValueError(f"no such place in the schema: {ref}") from None
        return at

    def issues(self, schema: Any, v: Column, path: Column, refs: tuple[str, ...] = ()) -> Column:
        """What the value v at ``path`` breaks, as an array of (path, rule)."""
        if isinstance(schema, bool):
            return _none() if schema else F.array(F.struct(path.alias("path"), F.lit("false").alias("rule")))
        unknown = set(schema) - NOTES - CHECKED
        if unknown:
            raise ValueError(f"keywords that are not checked: {sorted(unknown)}")
        facts = F.struct(v.alias("v"), _kind(v).alias("kind"), F.try_variant_get(v, "$", "double").alias("number"), F.try_variant_get(v, "$", "map<string,variant>").alias("object"), F.try_variant_get(v, "$", "array<variant>").alias("array"), F.try_variant_get(v, "$", "string").alias("string"))
        return bind(facts, lambda x: self._of(schema, x, path, refs))

    def _of(self, schema: dict, x: Column, path: Column, refs: tuple[str, ...]) -> Column:
        own: list[Column] = []
        nested: list[Column] = []
        kind = x["kind"]

        def rule(broken: Column, name: str) -> None:
            own.append(F.when(F.coalesce(broken, F.lit(False)), F.struct(path.alias("path"), F.lit(name).alias("rule"))))

        def within(sub: Any, v: Column | None = None, at: Column | None = None) -> Column:
            return self.issues(sub, x["v"] if v is None else v, path if at is None else at, refs)

        fits = lambda sub: F.size(within(sub)) == 0
        if "$ref" in schema:
            ref = schema["$ref"]
            if refs.count(ref) >= self.depth:  # a schema that holds itself is followed so far and no further
                rule(F.lit(True), "depth")
            else:
                nested.append(self.issues(self.resolve(ref), x["v"], path, (*refs, ref)))
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            good = F.lit(False)
            for name in names:
                here = kind.isin(*_KINDS[name])
                good = good | (here & (x["number"] == F.floor(x["number"])) if name == "integer" else here)
            rule(~good, "type")
        if "enum" in schema:
            rule(~F.array_contains(F.array(*[_literal(e) for e in schema["enum"]]), _same(x["v"])), "enum")
        if "const" in schema:
            rule(_same(x["v"]) != _literal(schema["const"]), "const")
        self._numbers(schema, x, rule)
        self._strings(schema, x, rule)
        self._arrays(schema, x, path, rule, within, nested)
        self._objects(schema, x, path, rule, within, nested)
        nested += [within(sub) for sub in schema.get("allOf", [])]
        if "anyOf" in schema:
            rule(~self._any([fits(sub) for sub in schema["anyOf"]]), "anyOf")
        if "oneOf" in schema:
            rule(sum((fits(sub).cast("int") for sub in schema["oneOf"]), F.lit(0)) != 1, "oneOf")
        if "not" in schema:
            rule(fits(schema["not"]), "not")
        if "if" in schema:
            nested.append(F.when(fits(schema["if"]), within(schema.get("then", True))).otherwise(within(schema.get("else", True))))
        return F.concat(F.array_compact(F.array(*own)) if own else _none(), *[n.cast(_ISSUES) for n in nested]) if nested else (F.array_compact(F.array(*own)) if own else _none())

    @staticmethod
    def _any(found: list[Column]) -> Column:
        out = F.lit(False)
        for f in found:
            out = out | f
        return out

    @staticmethod
    def _numbers(schema: dict, x: Column, rule: Callable[[Column, str], None]) -> None:
        number = F.when(x["kind"].isin(*_NUMBERS), x["number"])
        for name, broken in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m), ("exclusiveMinimum", lambda m: number <= m), ("exclusiveMaximum", lambda m: number >= m), ("multipleOf", lambda m: F.abs(number / m - F.round(number / m)) > 1e-9)):
            if name in schema:
                rule(broken(F.lit(float(schema[name]))), name)

    @staticmethod
    def _strings(schema: dict, x: Column, rule: Callable[[Column, str], None]) -> None:
        string = F.when(x["kind"] == "STRING", x["string"])
        for name, broken in (("minLength", lambda m: F.length(string) < m), ("maxLength", lambda m: F.length(string) > m), ("pattern", lambda m: ~string.rlike(m))):
            if name in schema:
                rule(broken(schema[name]), name)

    @staticmethod
    def _arrays(schema: dict, x: Column, path: Column, rule: Callable[[Column, str], None], within: Callable[..., Column], nested: list[Column]) -> None:
        array = F.when(x["kind"] == "ARRAY", x["array"])
        if "minItems" in schema:
            rule(array.isNotNull() & (F.size(array) < schema["minItems"]), "minItems")
        if "maxItems" in schema:
            rule(array.isNotNull() & (F.size(array) > schema["maxItems"]), "maxItems")
        if schema.get("uniqueItems"):
            each = F.transform(array, _same)
            rule(array.isNotNull() & (F.size(F.array_distinct(each)) < F.size(each)), "uniqueItems")
        first = schema.get("prefixItems", [])
        for i, sub in enumerate(first):
            nested.append(F.when(array.isNotNull() & (F.size(array) > i), within(sub, F.get(array, F.lit(i)), _place(path, F.lit(i)))).otherwise(_none()))
        if "items" in schema:
            found = F.transform(array, lambda e, i: F.when(i >= len(first), within(schema["items"], e, _place(path, i))).otherwise(_none()))
            nested.append(F.coalesce(F.flatten(found), _none()))
        if "contains" in schema:
            good = F.size(F.filter(array, lambda e: F.size(within(schema["contains"], e)) == 0))
            rule(array.isNotNull() & (good < schema.get("minContains", 1)), "contains")
            if "maxContains" in schema:
                rule(array.isNotNull() & (good > schema["maxContains"]), "maxContains")

    @staticmethod
    def _objects(schema: dict, x: Column, path: Column, rule: Callable[[Column, str], None], within: Callable[..., Column], nested: list[Column]) -> None:
        object_ = F.when(x["kind"] == "OBJECT", x["object"])
        keys = F.map_keys(object_)
        for name in schema.get("required", []):
            rule(object_.isNotNull() & ~F.array_contains(keys, name), f"required {name}")
        for name, needed in schema.get("dependentRequired", {}).items():
            for other in needed:
                rule(F.array_contains(keys, name) & ~F.array_contains(keys, other), f"dependentRequired {other}")
        if "minProperties" in schema:
            rule(object_.isNotNull() & (F.size(object_) < schema["minProperties"]), "minProperties")
        if "maxProperties" in schema:
            rule(object_.isNotNull() & (F.size(object_) > schema["maxProperties"]), "maxProperties")

        def child_of(name: str, sub: Any) -> Callable[[Column], Column]:
            return lambda c: F.when(c.isNotNull(), within(sub, c, _at(path, F.lit(name)))).otherwise(_none())

        for name, sub in schema.get("properties", {}).items():
            nested.append(F.coalesce(bind(F.try_element_at(object_, F.lit(name)), child_of(name, sub)), _none()))

        def of_entries(sub: Any, chosen: Callable[[Column], Column]) -> Column:
            entries = F.filter(F.map_entries(object_), lambda e: chosen(e["key"]))
            return F.coalesce(F.flatten(F.transform(entries, lambda e: within(sub, e["value"], _at(path, e["key"])))), _none())

        patterns = schema.get("patternProperties", {})
        nested += [of_entries(sub, lambda k, p=p: k.rlike(p)) for p, sub in patterns.items()]

        def extra(k: Column) -> Column:
            out = ~k.isin(*schema["properties"]) if schema.get("properties") else F.lit(True)
            for p in patterns:
                out = out & ~k.rlike(p)
            return out

        more = schema.get("additionalProperties", True)
        if more is False:
            rule(F.size(F.filter(keys, extra)) > 0, "additionalProperties")
        elif more is not True:
            nested.append(of_entries(more, extra))
        if "propertyNames" in schema:
            quoted = lambda k: F.parse_json(F.to_json(F.array(k)))  # noqa: E731  the key as a JSON value, in a list
            bad = F.filter(keys, lambda k: F.size(within(schema["propertyNames"], F.try_variant_get(quoted(k), "$[0]", "variant"))) > 0)
            rule(F.size(bad) > 0, "propertyNames")


def issues(schema: dict | bool, value: Column, depth: int = 4) -> Column:
    """An array of (path, rule), sorted, of what a VARIANT breaks; a null value (text that isn't JSON) breaks ``json``.

    A path is ``$``, ``$.a.b[0]`` or, for a list at the top, ``$.[0]``.  A rule is the keyword broken; of ``required`` and
    ``dependentRequired`` it names the key that is missing.  30.0 counts as an integer.  ``$ref`` may point anywhere in the
    schema; one that leads back to itself is followed ``depth`` times, and deeper values break ``depth``.  Patterns are
    Java's.  Keywords that are neither checked nor notes raise a ValueError instead of passing unseen.
    """
    whole = _Compiler(schema, depth).issues(schema, value, F.lit("$"))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))).cast(_ISSUES)
    return F.array_sort(F.when(value.isNull(), broken).otherwise(whole.cast(_ISSUES)))
