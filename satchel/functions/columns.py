"""Store encodings as column expressions: flag sets, levels, policies, action payloads, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = {0: "probed", 1: "meta", 2: "full"}
KINDS = ("add", "set-flags", "remove", "move", "copy", "update")


def flags_decode(flags: Column) -> Column:
    """The flag set of a JSON column: sorted and distinct; empty for null, malformed or any element that isn't a string."""
    parsed = F.try_parse_json(flags)
    strings = F.schema_of_variant(parsed).isin("ARRAY<STRING>", "ARRAY<VOID>")
    items = F.from_json(flags, "array<string>")
    good = strings & ~F.exists(items, lambda x: x.isNull())
    return F.when(good, F.array_sort(F.array_distinct(items))).otherwise(F.array().cast("array<string>"))


def flags_encode(flags: Column) -> Column:
    """The JSON of a flag set; a null set is written as the empty one."""
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(flags))), F.lit("[]"))


def level_decode(level: Column) -> Column:
    return F.when(level.isin(1, 2), level).otherwise(F.lit(0))


def level_name(level: Column) -> Column:
    return F.when(level == 1, "meta").when(level == 2, "full").otherwise("probed")


def policy(conflict: Column) -> Column:
    return F.when(conflict.isin("prefer-incoming", "prefer-existing"), conflict).otherwise("manual")


def blob_path(hash_: Column) -> Column:
    """Where a body lies below the blob folder; short names lie flat."""
    return F.when(F.length(hash_) < 4, hash_).otherwise(F.concat_ws("/", F.substring(hash_, 1, 2), F.substring(hash_, 3, 2), hash_))


def humanise(size: Column) -> Column:
    """Bytes in units of 1024 with one decimal (halves to the even one), whole bytes below that."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", F.bround(size / float(1024**k), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def dash(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("-"))


def typed(payload: Column, key: str, kind: str) -> Column:
    """A payload's field, null unless it has exactly that JSON type."""
    field = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(field) == {"string": "STRING", "bigint": "BIGINT"}[kind], F.try_variant_get(F.try_parse_json(payload), f"$.{key}", kind))


def mistyped(payload: Column, key: str) -> Column:
    """Whether a field is there and isn't a string."""
    field = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    return F.coalesce(field.isNotNull() & (F.schema_of_variant(field) != "STRING"), F.lit(False))


def payload_flags(payload: Column) -> Column:
    """A payload's flag set as JSON: what isn't a string is left out; without an array the set is empty."""
    held = F.try_variant_get(F.try_parse_json(payload), "$.flags", "array<variant>")
    strings = F.transform(F.filter(held, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return flags_encode(strings)


def payload_meta(payload: Column) -> Column:
    """A payload's summary: a string as it is, anything else as JSON."""
    field = F.try_variant_get(F.try_parse_json(payload), "$.meta", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(F.try_parse_json(payload), "$.meta", "string")).otherwise(F.to_json(field))


def payload_decode(action: Column, payload: Column) -> Column:
    """(kind, seq, to, object, link_id, handle, error): error is null for a payload that can be applied, or that is well formed
    and of a kind that isn't known."""
    parsed = F.try_parse_json(payload)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    version = typed(payload, "v", "bigint")
    seq, to, body, link, handle = typed(payload, "seq", "bigint"), *(typed(payload, k, "string") for k in ("to", "object", "link_id", "handle"))
    known = action.isin(*KINDS)
    error = (
        F.when(~is_object, "malformed payload")
        .when(version.isNull() | (version != 1), "unsupported version")
        .when(known & (action != "add") & seq.isNull(), "missing field: seq")
        .when(action.isin("move", "copy") & to.isNull(), "missing field: to")
        .when((action == "update") & body.isNull(), "missing field: object")
        .when((action == "add") & mistyped(payload, "link_id"), "missing field: link_id")
        .when(((action == "add") | ~known) & mistyped(payload, "object"), "missing field: object")
        .when((action == "add") & mistyped(payload, "handle"), "missing field: handle")
    )
    return F.struct(F.when(known, action).otherwise("unknown").alias("kind"), seq.alias("seq"), to.alias("to"), body.alias("object"), link.alias("link_id"), handle.alias("handle"), error.alias("error"))


def payload_encode(seq: Column | None = None, to: Column | None = None, flags: Column | None = None, body: Column | None = None, link: Column | None = None, meta: Column | None = None, handle: Column | None = None) -> Column:
    """A version-1 payload; what isn't given or is null is left out. A summary that is JSON is embedded as such."""
    value = None if meta is None else F.when(F.try_parse_json(meta).isNotNull(), F.to_json(F.try_parse_json(meta))).when(meta.isNotNull(), F.regexp_extract(F.to_json(F.array(meta)), r"(?s)^\[(.*)\]$", 1))
    named = {"seq": seq, "to": to, "link_id": link, "flags": flags, "object": body, "handle": handle}
    own = F.to_json(F.struct(F.lit(1).alias("v"), *(c.alias(k) for k, c in named.items() if c is not None)))
    if value is None:
        return own
    return F.when(value.isNull(), own).otherwise(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"meta":'), value, F.lit("}")))


def action_summary(action: Column, payload: Column) -> Column:
    """One line about a queued action."""
    p = payload_decode(action, payload)
    of = F.concat(F.lit(" #"), dash(p["seq"]))
    return (
        F.when(p["error"].isNotNull(), F.concat(action, F.lit(": "), p["error"]))
        .when(action.isin("move", "copy"), F.concat(action, of, F.lit(" to "), p["to"]))
        .when(action.isin(*KINDS), F.concat(action, F.when(action == "add", "").otherwise(of)))
        .otherwise(F.concat(F.lit("unknown: "), action))
    )
