import json

import pytest
from pyspark.sql import functions as F

from scrivener.functions import schema, validate


def found(spark, rules, *values, depth=8):
    rows = [(i, v if isinstance(v, str) and v.startswith("{broken") else json.dumps(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", schema.issues(rules, F.try_parse_json("j"), depth).alias("x"))
    return [[(x.path, x.rule) for x in r.x] for r in df.orderBy("i").collect()]


def test_types_and_numbers(spark):
    assert found(spark, {"type": "integer", "minimum": 0, "maximum": 10}, 3, 30.0, 3.5, "3", -1, None, True, [], 4.0) == [[], [("$", "maximum")], [("$", "type")], [("$", "type")], [("$", "minimum")], [("$", "type")], [("$", "type")], [("$", "type")], []]
    assert found(spark, {"type": ["string", "null"]}, "a", None, 1) == [[], [], [("$", "type")]]
    assert found(spark, {"exclusiveMinimum": 1, "exclusiveMaximum": 2, "multipleOf": 0.25}, 1, 1.25, 2, 1.3, "x") == [[("$", "exclusiveMinimum")], [], [("$", "exclusiveMaximum")], [("$", "multipleOf")], []]
    assert found(spark, True, 1) == [[]] and found(spark, False, 1) == [[("$", "false")]] and found(spark, {}, "{broken") == [[("$", "json")]]


def test_strings_enum_const(spark):
    assert found(spark, {"minLength": 2, "maxLength": 3, "pattern": "b$"}, "b", "ab", "aéb", "abcb", "漢字b", 5) == [[("$", "minLength")], [], [], [("$", "maxLength")], [], []]
    assert found(spark, {"enum": [1, "1", None, [1, 2], {"a": "b"}]}, 1.0, "1", None, [1, 2], {"a": "b"}, [2, 1], False, 2) == [[], [], [], [], [], [("$", "enum")], [("$", "enum")], [("$", "enum")]]
    assert found(spark, {"const": "x"}, "x", "y", 1) == [[], [("$", "const")], [("$", "const")]]


def test_arrays(spark):
    rules = {"items": {"type": "string"}, "minItems": 1, "maxItems": 3, "uniqueItems": True}
    assert found(spark, rules, [], ["a", "a"], ["a", 1], list("abcd"), {"a": 1}) == [[("$", "minItems")], [("$", "uniqueItems")], [("$.[1]", "type")], [("$", "maxItems")], []]
    assert found(spark, {"uniqueItems": True}, [1, 1.0], [1, "1"]) == [[("$", "uniqueItems")], []]
    assert found(spark, {"prefixItems": [{"type": "integer"}], "items": False}, [1], ["x"], [1, 2], []) == [[], [("$.[0]", "type")], [("$.[1]", "false")], []]
    assert found(spark, {"contains": {"const": 1}, "maxContains": 1}, [1], [2], [1, 1]) == [[], [("$", "contains")], [("$", "maxContains")]]


def test_objects(spark):
    rules = {"properties": {"a": {"type": "object", "properties": {"b": {"items": {"type": "object", "required": ["c"]}}}}}, "patternProperties": {"^x_": {"type": "integer"}}, "additionalProperties": False, "required": ["a"]}
    assert found(spark, rules, {"a": {"b": [{"c": 1}, {}]}}, {"z": 1}, {"a": 5, "x_1": "s"}, [], {"a": None}) == [[("$.a.b[1]", "required c")], [("$", "additionalProperties"), ("$", "required a")], [("$.a", "type"), ("$.x_1", "type")], [], [("$.a", "type")]]
    assert found(spark, {"additionalProperties": {"type": "string"}, "minProperties": 1, "maxProperties": 2}, {"k": 1}, {}, {"a": "", "b": "", "c": ""}) == [[("$.k", "type")], [("$", "minProperties")], [("$", "maxProperties")]]
    assert found(spark, {"dependentRequired": {"a": ["b"]}, "propertyNames": {"maxLength": 2}}, {"a": 1}, {"a": 1, "b": 1}, {"abc": 1}) == [[("$", "dependentRequired b")], [], [("$", "propertyNames")]]


def test_combined_and_references(spark):
    assert found(spark, {"anyOf": [{"type": "string"}, {"minimum": 5}]}, "a", 6, 4) == [[], [], [("$", "anyOf")]]
    assert found(spark, {"oneOf": [{"minimum": 5}, {"multipleOf": 2}]}, 6, 5, 2, 1) == [[("$", "oneOf")], [], [], [("$", "oneOf")]]
    assert found(spark, {"not": {"required": ["secret"]}, "allOf": [{"type": "object"}]}, {"secret": 1}, {}, 1) == [[("$", "not")], [], [("$", "not"), ("$", "type")]]
    assert found(spark, {"if": {"properties": {"k": {"const": 1}}}, "then": {"required": ["a"]}, "else": {"required": ["b"]}}, {"k": 1}, {"k": 2}, {"k": 1, "a": 0}) == [[("$", "required a")], [("$", "required b")], []]
    tree = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}}}}}
    assert found(spark, tree, {"next": {"next": 5}}, {"next": {"next": {"next": {}}}}, depth=3) == [[("$.next.next", "type")], [("$.next.next.next", "depth")]]


def test_refused_schemas(spark, tmp_path):
    for bad in ({"unevaluatedItems": False}, {"$ref": "http://a/b"}, {"$ref": "#/$defs/none"}):
        with pytest.raises(ValueError):
            schema.issues(bad, F.col("x"))
    with pytest.raises(RuntimeError):
        schema.load_schema(spark, f"{tmp_path}/absent.json")
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(RuntimeError):
        schema.load_schema(spark, f"{tmp_path}/broken.json")


def test_the_forms_own_schema(spark):
    fields = {g: {k: {"string": "x", "integer": 5, "boolean": True, "array": []}[f[0]] if len(f) < 2 or not isinstance(f[1], list) or f[0] == "array" else f[1][0] for k, f in d.items()} for g, d in validate.FORM.items()}
    good = fields.pop("") | fields
    bad = json.loads(json.dumps(good))
    bad["payment"]["payment_term_days"], bad["delivery"]["delivery_term_days"], bad["liability"]["exceptions_to_cap"] = 30.0, 0, ["fraud", "fraud", "none"]
    del bad["currency"]
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad))], "i int, f string")
    got = sorted((r.i, r.path, r.rule) for r in validate.form_issues(df, "i", "f").collect())
    assert got == [(2, "$", "required currency"), (2, "$.delivery.delivery_term_days", "minimum"), (2, "$.liability.exceptions_to_cap", "uniqueItems"), (2, "$.liability.exceptions_to_cap[2]", "enum")]
