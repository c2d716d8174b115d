"""Whether a JSON value has the fields that its kind needs: one decode, one lookup in a table of rules.

A value's fields are told once, as a map of each object's fields to what they are; a kind's
rules are looked up in a literal, and what doesn't fit comes out as issues with a code and a
path. Plans stay small however many kinds there are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import bound

RULE = "array<struct<object: string, key: string, kinds: array<string>, values: array<string>, optional: boolean>>"
Rules = list[tuple[str, str, str, bool]]
#: The kinds that a rule's kind allows besides itself.
ALSO = {
    "number": ["unsigned", "zero", "positive"], "unsigned": ["zero"], "positive": ["unsigned"], "nonnegative": ["unsigned", "zero", "positive"],
    "string": ["empty"], "some": ["string"], "array": ["strings", "none"], "strings": ["none"],
}


def kind_of(value: Column) -> Column:
    """What a variant is: string, number (zero; unsigned: a whole one over zero; positive: another), boolean, object, array (strings: of such alone; none: of nothing, or nulls) or null."""

    def told(schema: Column) -> Column:
        word = F.regexp_extract(schema, "^[A-Z]+", 0)
        size = F.try_variant_get(value, "$", "double")
        number = F.when(size == 0, "zero").when((size > 0) & (word == "BIGINT"), "unsigned").when(size > 0, "positive").otherwise("number")
        listed = F.when(schema == "ARRAY<STRING>", "strings").when(schema == "ARRAY<VOID>", "none")
        return F.when(word.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), number).when(word == "VOID", "null").otherwise(F.coalesce(listed, F.lower(word)))

    return bound(F.schema_of_variant(value), told)


def fields(value: Column, path: str = "") -> Column:
    """An object's fields by name, each a struct of its kind (of a string without characters: empty) and, of a string, its first characters; null if there is no object."""
    found = F.try_variant_get(value, f"$.{path}" if path else "$", "map<string,variant>")
    text = lambda x: F.substring(F.try_variant_get(x, "$", "string"), 1, 64)
    told = lambda kind, said: F.struct(F.when(said == "", "empty").otherwise(kind).alias("kind"), said.alias("text"))
    return F.transform_values(found, lambda _, x: bound(kind_of(x), lambda kind: bound(F.when(kind == "string", text(x)), lambda said: told(kind, said))))


def kinds(value: Column, objects: tuple[str, ...]) -> Column:
    """The fields of the objects at some paths: map<path, map<name, struct<kind, text>>>."""
    return F.create_map(*(x for path in objects for x in (F.lit(path), fields(value, path))))


def rules(table: dict[str, dict[str, str]], optional: dict[str, dict[str, str]] | None = None) -> Rules:
    """Rules of an object path's fields; kinds of one field are separated by |, and =a|b are the values of a string."""
    needed = [(path, name, kind, False) for path, named in table.items() for name, kind in named.items()]
    return needed + [(path, name, kind, True) for path, named in (optional or {}).items() for name, kind in named.items()]


def rules_of_text(table: str) -> dict[str, Rules]:
    """Rules by tag, a line each: ``tag: field kind, field kind``; a kind that ends in ? may be absent, in ~ also null."""
    out: dict[str, Rules] = {}
    for line in filter(None, map(str.strip, table.splitlines())):
        tag, _, named = line.partition(":")
        out[tag] = []
        for name, kind in (field.split() for field in named.split(",") if field.strip()):
            plain = kind.rstrip("?~") + ("|null" if kind.endswith("~") else "")
            path, _, key = name.rpartition(".")
            out[tag].append((path, key, plain, kind[-1] in "?~"))
    return out


def lookup(table: dict[str, Rules], tag: Column) -> Column:
    """The rules of a tag, null if it has none."""

    def rule(path: str, key: str, kind: str, maybe: bool) -> dict:
        named = kind.lstrip("=").split("|")
        if kind.startswith("="):
            return {"object": path, "key": key, "kinds": ["string"] + ["null"] * ("null" in named), "values": named, "optional": maybe}
        return {"object": path, "key": key, "kinds": [x for k in named for x in (k, *ALSO.get(k, ()))], "values": None, "optional": maybe}

    told = {tag: [rule(*r) for r in own] for tag, own in table.items()}
    return F.try_element_at(F.from_json(F.lit(json.dumps(told)), f"map<string, {RULE}>"), tag)


def issues(found: Column, own: Column) -> Column:
    """array<struct<code, path>>: missing, wrong_type or wrong_value for each rule that doesn't hold; rules below what is no object are left out."""

    def told(found: Column) -> Column:
        at = lambda r: F.try_element_at(F.try_element_at(found, r["object"]), r["key"])
        typed = lambda r: F.coalesce(F.array_contains(r["kinds"], at(r)["kind"]), r["optional"])
        valued = lambda r: r["values"].isNull() | F.coalesce(F.array_contains(r["values"], at(r)["text"]), F.lit(True))
        bad = F.filter(own, lambda r: F.try_element_at(found, r["object"]).isNotNull() & ~(typed(r) & valued(r)))
        path = lambda r: F.concat_ws(".", F.nullif(r["object"], F.lit("")), r["key"])
        code = lambda r: F.when(at(r).isNull(), "missing").when(typed(r), "wrong_value").otherwise("wrong_type")
        return F.transform(bad, lambda r: F.struct(code(r).alias("code"), path(r).alias("path")))

    return bound(found, told)


def all_fit(items: Column, own: Rules) -> Column:
    """Whether each item of array<variant> is an object with the fields of the rules."""
    fits = lambda x: bound(kinds(x, ("",)), lambda found: F.try_element_at(found, F.lit("")).isNotNull() & (F.size(issues(found, lookup({"": own}, F.lit("")))) == 0))
    return F.forall(items, lambda x: F.coalesce(fits(x), F.lit(False)))


def items_fit(items: Column, table: dict[str, dict[str, str]], optional: dict[str, dict[str, str]] | None = None) -> Column:
    """Whether each item of array<variant> is an object whose ``type`` is in the table and has that type's fields; null is no array."""
    of = {tag: rules({"": named}, {"": (optional or {}).get(tag, {})}) for tag, named in table.items()}

    def fits(x: Column) -> Column:
        def all_hold(found: Column) -> Column:
            of_string = F.try_element_at(F.try_element_at(found, F.lit("")), F.lit("type"))["kind"] == "string"
            return F.size(issues(found, lookup(of, F.when(of_string, F.try_variant_get(x, "$.type", "string"))))) == 0

        return F.coalesce(bound(kinds(x, ("",)), all_hold), F.lit(False))

    return F.forall(items, fits)
