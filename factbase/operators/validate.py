"""Validation of raw pack documents held as VARIANT. Never raises: one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factbase.schema import CONFIDENCES, FACT_TYPES

V = "variant"


def whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, else NULL.

    The parser ignores what follows the first value. So the text is parsed as the first of two elements, the second
    being a number that only the text itself decides: it is missing where the value ended early, and a text with
    more than one value gives more than two elements.
    """
    seal = F.xxhash64(text).cast("string")
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), seal, F.lit("]"))), "$", "array<variant>")
    sealed = (F.size(pair) == 2) & (F.try_variant_get(F.try_element_at(pair, F.lit(2)), "$", "string") == seal)
    return F.when(sealed, F.try_element_at(pair, F.lit(1)))


def with_variant(raw_packs: DataFrame) -> DataFrame:
    """raw_packs + v, NULL where the text is not one JSON value. The one-element explode is a barrier: without
    it, filters on v would be pushed down with one parse per use of v."""
    return raw_packs.withColumn("v", F.explode(F.array(whole_json(F.col("doc")))))


def parse_raw(raw_packs: DataFrame) -> DataFrame:
    return with_variant(raw_packs).select("file", "v")


# Names of value types, by the first word of the variant's schema.
KINDS = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "VOID": "none",
         "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float"}


def kind(v: Column) -> Column:
    """Type of a variant value: dict, list, str, int, float, bool or none; NULL when absent."""
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(names, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def listed(v: Column) -> Column:
    """The elements of a variant list, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def child(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", V)


ROW = "array<struct<path:string,code:string,detail:string>>"


def _rows(checks: list[tuple[Column, Column, str, Column | None]]) -> Column:
    """checks (condition, path, code, detail) to the array of those that hold."""
    none = F.lit(None).cast("string")
    rows = [F.when(cond, F.struct(path.alias("path"), F.lit(code).alias("code"),
                                  (none if detail is None else detail).alias("detail")))
            for cond, path, code, detail in checks]
    return F.filter(F.array(*rows), lambda r: r.isNotNull()).cast(ROW)


def _each(items: Column, check) -> Column:
    """All violations of the elements of a list (none if it is not a list)."""
    return F.coalesce(F.flatten(F.transform(items, check)), F.array().cast(ROW))


def _one_of(v: Column, allowed: list[str]) -> Column:
    return (kind(v) == "str") & F.coalesce(text_of(v).isin(allowed), F.lit(False))


def _fact_rows(e: Column, i: Column) -> Column:
    at = F.concat(F.lit("facts["), i.cast("string"), F.lit("]"))
    key, value, type_, conf = (child(e, n) for n in ["key", "value", "type", "confidence"])
    ok, value_kind = kind(e) == "dict", kind(value)
    rows = _rows([
        (~ok, at, "fact_not_mapping", kind(e)),
        (ok & kind(key).isNull(), at, "fact_missing_key", None),
        (ok & value_kind.isNull(), at, "fact_missing_value", None),
        (ok & (kind(key) != "str"), F.concat(at, F.lit(".key")), "fact_key_not_string", kind(key)),
        (ok & ~value_kind.isin("str", "list"), F.concat(at, F.lit(".value")), "fact_value_bad_type", value_kind),
        (ok & (value_kind == "list") & (F.size(listed(value)) == 0), F.concat(at, F.lit(".value")),
         "fact_value_empty", None),
        (ok & type_.isNotNull() & ~_one_of(type_, FACT_TYPES), F.concat(at, F.lit(".type")),
         "fact_bad_type", text_of(type_)),
        (ok & conf.isNotNull() & ~_one_of(conf, CONFIDENCES), F.concat(at, F.lit(".confidence")),
         "fact_bad_confidence", text_of(conf))])

    def item_rows(x: Column, j: Column) -> Column:
        return _rows([(kind(x) != "str", F.concat(at, F.lit(".value["), j.cast("string"), F.lit("]")),
                       "fact_item_not_string", kind(x))])

    return F.concat(rows, F.when(ok, _each(listed(value), item_rows)).otherwise(F.array().cast(ROW)))


def _rule_rows(e: Column, i: Column) -> Column:
    at = F.concat(F.lit("rules["), i.cast("string"), F.lit("]"))
    text, priority = child(e, "instruction"), child(e, "priority")
    ok, number = kind(e) == "dict", F.try_variant_get(priority, "$", "bigint")
    return _rows([
        (~ok, at, "rule_not_mapping", kind(e)),
        (ok & kind(text).isNull(), at, "rule_missing_instruction", None),
        (ok & (kind(text) != "str"), F.concat(at, F.lit(".instruction")), "rule_instruction_not_string", kind(text)),
        # booleans count as the integers 0 and 1
        (ok & ~kind(priority).isin("int", "bool"), F.concat(at, F.lit(".priority")), "rule_priority_not_int",
         kind(priority)),
        (ok & (kind(priority) == "int") & ~number.between(0, 10), F.concat(at, F.lit(".priority")),
         "rule_priority_range", number.cast("string"))])


def violations(v: str = "v") -> Column:
    """All violations of one document as an array: one pass, no shuffle, no second parse."""
    doc = F.col(v)
    name, scope, facts, rules = (child(doc, n) for n in ["name", "scope", "facts", "rules"])
    text, is_name = text_of(name), kind(name) == "str"
    good_start = text.rlike(r"^\p{Ll}")
    top = _rows([
        (kind(name).isNull(), F.lit("name"), "missing_name", None),
        (kind(scope).isNull(), F.lit("scope"), "missing_scope", None),
        (~is_name, F.lit("name"), "name_not_string", kind(name)),
        (is_name & ~good_start, F.lit("name"), "name_bad_start", text),
        (is_name & good_start & ~text.rlike(r"^[\p{L}\p{N}_-]*$"), F.lit("name"), "name_bad_chars", text),
        (kind(scope) != "str", F.lit("scope"), "scope_not_string", kind(scope)),
        (kind(facts) != "list", F.lit("facts"), "facts_not_list", kind(facts)),
        (kind(rules) != "list", F.lit("rules"), "rules_not_list", kind(rules))])
    root = _rows([(doc.isNull(), F.lit("$"), "unreadable", None),
                  (kind(doc) != "dict", F.lit("$"), "root_not_mapping", kind(doc))])
    inside = F.concat(top, _each(listed(facts), _fact_rows), _each(listed(rules), _rule_rows))
    return F.when(kind(doc) == "dict", inside).otherwise(root)


def validate_packs(raw_packs: DataFrame) -> DataFrame:
    """(file, path, code, detail); `detail` is the offending type or value."""
    return parse_raw(raw_packs).select("file", F.inline(violations()))


def validation_summary(raw_packs: DataFrame) -> DataFrame:
    errors = parse_raw(raw_packs).select("file", F.size(violations()).cast("bigint").alias("errors"))
    return errors.select("file", (F.col("errors") == 0).alias("valid"), "errors")
