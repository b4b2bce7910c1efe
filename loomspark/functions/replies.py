"""Parsing what models reply: JSON in prose, seed lists, verdicts, dialogues, rewritten instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

PREFIXES = tuple(f"{lead}:" for lead in "Rewritten instruction|Rewritten|Instruction".split("|"))


def json_blob(raw: Column) -> Column:
    """The JSON-looking part of a reply: inside a code fence if there is one, then the bracket or brace span that begins first; null if none."""
    fence = r"(?is)`{3}(?:json|)\s*(.+?)`{3}"

    def pick(body: Column) -> Column:
        def span(a: str, b: str) -> tuple[Column, Column]:
            start = F.locate(a, body)
            end = F.length(body) - F.locate(b, F.reverse(body)) + 1
            ok = (start > 0) & (F.locate(b, body) > 0) & (end > start)
            return F.when(ok, start), F.when(ok, F.substring(body, start, end - start + 1))

        list_at, list_part = span("[", "]")
        dict_at, dict_part = span("{", "}")
        return F.when(list_at.isNotNull() & (dict_at.isNull() | (list_at < dict_at)), list_part).otherwise(dict_part)

    return let(strip(raw), lambda text: let(F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text), pick))


def json_value(raw: Column) -> Column:
    """The reply's JSON as a VARIANT, null if there is none or it doesn't parse."""
    return F.try_parse_json(json_blob(raw))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def seeds(raw: Column) -> Column:
    """Array of the instructions of a reply: strings, or the first non-empty of instruction, question and prompt of objects; 8 to 500 characters."""

    def of_part(part: Column, otherwise: Column) -> Column:
        text = F.try_variant_get(part, "$", "string")
        empty = part.isNull() | (kind(part) == "VOID") | F.coalesce(text.isin("", "0", "false", "[]", "{}", "0.0") & ~((kind(part) == "STRING") & (text != "")), F.lit(False))
        return F.when(empty, otherwise).when(kind(part) == "STRING", text)

    def text(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for key in reversed(("instruction", "question", "prompt")):
            out = of_part(F.try_variant_get(v, f"$.{key}", "variant"), out)
        return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(v).startswith("OBJECT"), out)

    # not every array is a list of one type, so elements are variants
    items = let(json_blob(raw), lambda blob: F.from_json(F.when(F.try_parse_json(blob).isNotNull() & blob.startswith("["), blob), "array<variant>"))
    found = F.filter(F.transform(items, lambda v: strip(text(v))), lambda s: s.isNotNull() & F.length(s).between(8, 500))
    return let(found, lambda f: F.coalesce(f, F.array().cast("array<string>")))


def verdict(raw: Column) -> Column:
    """Struct (score, reason) of a judge's reply: a half-even rounded score in 0..10, 0 where there is none; up to 240 characters of reason."""

    def read(value: Column) -> Column:
        text = F.try_variant_get(value, "$.score", "string")
        number = F.coalesce(F.try_variant_get(value, "$.score", "double"), F.when(text == "true", 1.0).when(text == "false", 0.0), strip(text).try_cast("double"))
        score = let(number, lambda x: F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(F.rint(F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)), F.lit(0.0)).cast("int"))))
        has_reason = F.coalesce(kind(value).contains("reason:"), F.lit(False))
        reason = F.when(has_reason, F.coalesce(F.try_variant_get(value, "$.reason", "string"), F.lit("None"))).otherwise("")
        return F.when(F.coalesce(kind(value).startswith("OBJECT"), F.lit(False)), F.struct(score.alias("score"), F.substring(strip(reason), 1, 240).alias("reason"))).otherwise(
            F.struct(F.lit(0).alias("score"), F.lit("unparseable judge response").alias("reason"))
        )

    return let(json_value(raw), read)


def evolution(raw: Column, original: Column) -> Column:
    """A rewritten instruction without known prefixes and quotes; null if it isn't 8 to 800 characters or says the same."""

    def cut(text: Column, left: tuple[str, ...]) -> Column:
        if not left:
            bare = F.btrim(text, F.lit("\"'`"))
            return let(bare, lambda t: F.when(F.length(t).between(8, 800) & (F.lower(t) != F.lower(strip(original))), t))
        begins = F.lower(F.substring(text, 1, len(left[0]))) == left[0].lower()
        return let(F.when(begins, strip(F.substring(text, len(left[0]) + 1, 1_000_000_000))).otherwise(text), lambda t: cut(t, left[1:]))

    return let(strip(F.coalesce(raw, F.lit(""))), lambda t: cut(t, PREFIXES))


def alternates(messages: Column) -> Column:
    """Whether messages (role, content) alternate from user to assistant, at least two, none blank, the last the assistant's."""
    role = lambda m: F.lower(strip(m.role))
    each = F.forall(F.transform(messages, lambda m, i: (strip(m.content) != "") & (role(m) == F.when(i % 2 == 0, "user").otherwise("assistant"))), lambda ok: ok)
    return F.coalesce((F.size(messages) >= 2) & (F.size(messages) % 2 == 0) & each, F.lit(False))


def dialogue(raw: Column, turns: int) -> Column:
    """The valid dialogue of a reply, an array of (role, content) of at most `turns`; null if there is none."""
    shape = "struct<messages: array<struct<role: string, content: string>>>"
    got = let(json_blob(raw), lambda blob: F.when(kind(F.try_parse_json(blob)).startswith("OBJECT"), F.from_json(blob, shape).messages))
    clean = F.transform(got, lambda m: F.struct(F.lower(strip(m.role)).alias("role"), strip(m.content).alias("content")))
    return let(clean, lambda m: F.when(alternates(m), F.slice(m, 1, turns)))
