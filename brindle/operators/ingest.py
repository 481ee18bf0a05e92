"""Raw JSON events to normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.text import filled, ustrip

# Text fields of an event in their order of priority; texts that count as empty; control frames.
TEXT_FIELDS = ("content_cn", "content", "title_cn", "title", "new_full_text_cn", "new_full_text", "quo_text_cn", "quo_text", "full_text", "text")
EMPTY = ("", "null", "{}", "[]")
CONTROL = ("ping", "pong")

CANDIDATES = ("stoks", "stocks")  # where an event, or its envelope, has its candidates
_EVENT = "struct<" + ",".join([*(f"{c}:variant" for c in TEXT_FIELDS), *(f"{c}:string" for c in ("id_str", "id", "new_id", "item_url", "content_url", "create_time", "source_type", *CANDIDATES, "types", "tz", "stocker_id", "stocker_code", "stocker_name", "aliases", "type"))]) + ">"


def envelope_events(messages: DataFrame, key: str = "id", raw: str = "raw_event_json") -> DataFrame:
    """(key, place, event): the events of each envelope as JSON texts; control frames and invalid JSON give none.

    A list gives its objects; an object its `data`, else its `result` (one object or a list of them), else itself, also where
    these hold anything else. A wrapped event without candidates of its own has those of its envelope. A control frame has
    neither key.
    """
    m = messages.select(F.col(key).alias("message_id"), F.col(raw).alias("raw"), F.try_parse_json(F.col(raw)).alias("v"))
    m = m.withColumn("kind", F.schema_of_variant("v")).where("kind is not null")
    m = m.withColumn("keys", F.when(F.col("kind").startswith("OBJECT"), F.json_object_keys("raw")))
    part = lambda name: F.to_json(F.try_variant_get("v", f"$.{name}", "variant"))  # noqa: E731  JSON text
    has = lambda keys, name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    keys = F.col("keys")
    control = F.coalesce(F.get_json_object("raw", "$.type").isin(*CONTROL), F.lit(False)) & ~has(keys, "data") & ~has(keys, "result")
    first = F.coalesce(part("data"), F.lit("null")) != "null"
    wrapped = F.when(first, part("data")).otherwise(part("result"))
    inner = F.when(wrapped.rlike(r"^[{\[]"), F.when(first, F.get_json_object("raw", "$.data")).otherwise(F.get_json_object("raw", "$.result")))
    whole = F.when(F.col("kind").startswith("ARRAY"), F.col("raw")).when(keys.isNotNull() & ~control, F.coalesce(inner, F.col("raw")))
    m = m.select("message_id", whole.alias("whole"), *(F.when(inner.isNotNull() & has(keys, c), F.coalesce(part(c), F.lit("null"))).alias(c) for c in CANDIDATES))
    items = F.when(F.ltrim("whole").startswith("["), F.from_json("whole", "array<string>")).when(F.ltrim("whole").startswith("{"), F.array("whole"))
    out = m.select("message_id", *CANDIDATES, F.posexplode(items).alias("place", "event")).where(F.ltrim("event").startswith("{"))
    own = F.json_object_keys("event")
    extra = F.concat_ws(",", *(F.when(F.col(c).isNotNull() & ~has(own, c), F.concat(F.lit(f'"{c}":'), F.col(c))) for c in CANDIDATES))
    body = F.regexp_replace("event", r"\}\s*$", "")
    joined = F.concat(body, F.when(F.size(own) > 0, F.lit(",")).otherwise(F.lit("")), extra, F.lit("}"))
    return out.select("message_id", "place", F.when(extra != "", joined).otherwise(F.col("event")).alias("event"))


def parsed(events: DataFrame) -> DataFrame:
    return events.withColumn("e", F.from_json("event", _EVENT)).where("e is not null")


def extracted_text(e: Column) -> Column:
    """Distinct texts of the fields in priority, stripped, one a line; fields of any other type are no text."""
    strings = F.array(*(F.when(F.schema_of_variant(e[f]) == "STRING", F.variant_get(e[f], "$", "string")) for f in TEXT_FIELDS))
    texts = F.transform(strings, lambda x: ustrip(F.coalesce(x, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(texts, lambda x: ~F.lower(x).isin(*EMPTY))), "\n")


def source_kind(e: Column) -> Column:
    url = filled(e["item_url"], e["content_url"])
    explicit = F.lower(ustrip(F.coalesce(e["source_type"], F.lit(""))))
    twitter = F.contains(F.lower(url), F.lit("twitter.com/")) | F.contains(F.lower(url), F.lit("x.com/")) | (filled(e["id_str"]) != "")
    return F.when(explicit != "", explicit).when(twitter, "twitter").when((filled(e["content_url"]) != "") | (filled(e["types"]) != ""), "news").otherwise("unknown")


def records(events: DataFrame) -> DataFrame:
    """(message_id, place, source_id, source_type, source_url, published_at, text, source_key) of parsed events."""
    e = F.col("e")
    source_id = filled(e["id_str"], e["id"], e["new_id"])
    base = events.select("message_id", "place", source_id.alias("source_id"), source_kind(e).alias("source_type"), filled(e["item_url"], e["content_url"]).alias("source_url"), filled(e["create_time"]).alias("published_at"), extracted_text(e).alias("text"), "event")
    return base.withColumn("source_key", source_key(F.col("source_id"), F.col("event"), F.col("text"))).drop("event")


def source_key(source_id: Column, event: Column, text: Column) -> Column:
    """id:<id>, else event:<digest of the event in any order of its keys>, else text:<digest>."""
    canonical = F.to_json(F.try_parse_json(event))
    return F.when(ustrip(source_id) != "", F.concat(F.lit("id:"), ustrip(source_id))).when(F.coalesce(canonical, F.lit("{}")) != "{}", F.concat(F.lit("event:"), F.sha2(canonical, 256))).otherwise(F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256)))


def candidates(events: DataFrame) -> DataFrame:
    """(message_id, place, stocker_id, stocker_code, stocker_name, aliases, type) of the candidates that came with parsed events.

    `stoks` goes before `stocks`, also where it is empty; an event with neither that has a code is a candidate itself. Each may
    be a list, an object or their JSON text; codes are upper case without outer white space; all-blank candidates are dropped,
    and of those of one id, code and name the first is kept.
    """
    fields = ("stocker_id", "stocker_code", "stocker_name", "aliases", "type")
    kind = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    raw = F.coalesce(F.col("e.stoks"), F.col("e.stocks"))
    itself = F.when(filled(F.col("e.stocker_code")) != "", F.array(F.struct(*(F.col(f"e.{f}").alias(f) for f in fields))))
    items = F.when(raw.isNull(), itself).when(F.ltrim(raw).startswith("["), F.from_json(raw, f"array<{kind}>")).when(F.ltrim(raw).startswith("{"), F.array(F.from_json(raw, kind)))
    c = events.select("message_id", "place", F.posexplode(items).alias("nth", "c")).where("c is not null")
    text = lambda f: F.coalesce(F.col(f"c.{f}"), F.lit(""))
    listed = F.when(F.ltrim(text("aliases")).startswith("["), F.from_json(text("aliases"), "array<string>")).otherwise(F.array(text("aliases")))
    aliases = F.filter(F.transform(listed, lambda x: ustrip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    out = c.select("message_id", "place", "nth", text("stocker_id").alias("stocker_id"), F.upper(ustrip(text("stocker_code"))).alias("stocker_code"), ustrip(text("stocker_name")).alias("stocker_name"), aliases.alias("aliases"), text("type").alias("type"))
    key = ["message_id", "place", "stocker_id", "stocker_code", "stocker_name"]
    first = out.where("concat(stocker_id, stocker_code, stocker_name) <> ''").groupBy(*key).agg(F.min_by(F.struct("aliases", "type"), "nth").alias("r"))
    return first.select(*key, "r.aliases", "r.type")
