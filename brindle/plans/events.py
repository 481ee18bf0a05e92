"""Queries of ingest, normalisation and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import ingest as I, store as S
from brindle.session import table


def _events(spark, root):
    return I.parsed(I.envelope_events(table(spark, root, "messages")))


def envelope_flatten(spark, root):
    e = _events(spark, root)
    return e.select("message_id", F.col("place").cast("long").alias("place"), T.filled(F.col("e.id_str"), F.col("e.id"), F.col("e.new_id")).alias("source_id"))


def extract_text(spark, root):
    return _events(spark, root).select("message_id", F.col("place").cast("long").alias("place"), I.extracted_text(F.col("e")).alias("text"))


def source_type(spark, root):
    return _events(spark, root).select("message_id", F.col("place").cast("long").alias("place"), I.source_kind(F.col("e")).alias("source_type"))


def record_projection(spark, root):
    r = I.records(_events(spark, root))
    return r.select("message_id", F.col("place").cast("long").alias("place"), "source_id", "source_url", "published_at")


def record_key(spark, root):
    """Keys of all records; of an event's own digest, whose bytes differ by JSON writer, only the kind."""
    r = I.records(_events(spark, root))
    return r.select("message_id", F.col("place").cast("long").alias("place"), F.regexp_replace("source_key", "^event:.*", "event").alias("source_key"))


def record_key_event(spark, root):
    return I.records(_events(spark, root)).where("source_key like 'event:%'").select("message_id", "source_key")


def event_candidates(spark, root):
    return I.candidates(_events(spark, root)).groupBy("stocker_code").agg(F.count("*").alias("n"))


def heartbeat_filter(spark, root):
    """Frames made of the events: pings and pushes without data, with null, a text or an object as data."""
    kind, data = F.when(F.col("event_id") % 3 == 0, "ping").otherwise("push"), F.col("event_id") % 4
    rest = F.when(data == 0, "").when(data == 1, ',"data":null').when(data == 2, ',"data":"text"').otherwise(',"data":{"a":1}')
    e = table(spark, root, "events").select("event_id", F.concat(F.lit('{"type":"'), kind, F.lit('"'), rest, F.lit("}")).alias("raw"))
    return I.envelope_events(e, "event_id", "raw").groupBy(F.when(F.col("event").startswith('{"a"'), "inner").otherwise("whole").alias("kind")).agg(F.count("*").alias("n"))


def message_time(spark, root):
    return table(spark, root, "messages").select("id", F.coalesce(F.nullif(F.trim("published_at"), F.lit("")), "received_at").alias("message_time"))


def nonblank_messages(spark, root):
    return table(spark, root, "messages").where("trim(text) <> ''").select("id", F.length("text").alias("characters"))


def source_backfill(spark, root):
    url = F.lower("source_url")
    twitter = (F.col("source_type") == "unknown") & (F.contains(url, F.lit("twitter.com/")) | F.contains(url, F.lit("x.com/")))
    return table(spark, root, "messages").select(F.when(twitter, "twitter").otherwise(F.col("source_type")).alias("source_type")).groupBy("source_type").agg(F.count("*").alias("n"))


def normalize_dedup(spark, root):
    return table(spark, root, "messages").where("text is not null").select("id", T.dedup_form(F.col("text")).alias("form"))


def language_dist(spark, root):
    return table(spark, root, "messages").where("trim(text) <> ''").groupBy(T.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


def epoch_ms(spark, root):
    m = table(spark, root, "messages").where("published_at rlike '^[0-9]{13}$'")
    return m.select("id", T.to_iso(F.col("published_at").cast("long")).alias("iso"))


def synthetic_time(spark, root):
    """Times one second apart that end ten seconds before the earliest news; by the rank of the id."""
    from brindle.operators.timestamps import message_times

    news = table(spark, root, "messages").where("source_type = 'news'").select(F.col("id").alias("message_id"))
    t = message_times(table(spark, root, "messages")).where("field = 'received_at'").join(news, "message_id")
    anchor = t.agg(F.min("utc_time").alias("at"), F.count("*").alias("n")).first()
    ids = S.running_split(news.withColumn("one", F.lit(1)), "one", ["message_id"], [], "").select("message_id", (F.col("running") - 1).alias("place"))
    seconds = F.unix_timestamp(F.to_timestamp(F.lit(anchor["at"]))) + F.col("place") - F.lit(anchor["n"] + 10)
    return ids.select("message_id", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss").alias("synthetic"))


def save_messages_dedup(spark, root):
    m = table(spark, root, "messages").select("id", "source_key", "received_at")
    return S.first_per_key(m, "source_key", "id").select("source_key", "id")


def candidates_dedup(spark, root):
    u = table(spark, root, "upstream_candidates").select("message_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("stocker_id", "stocker_code", "stocker_name"))).distinct()
    return u.groupBy("message_id").agg(F.count("*").alias("n"))


def insert_or_ignore(spark, root):
    """Messages that came with candidate pairs are stored; the rest arrives."""
    m = table(spark, root, "messages").select("id", "source_key")
    stored = m.join(table(spark, root, "candidate_pairs").select(F.col("message_id").alias("id")), "id", "left_semi")
    return S.first_per_key(S.new_rows(m, stored, ["source_key"]), "source_key", "id").select("source_key", "id")


def latest_delivery(spark, root):
    return S.latest_per_key(table(spark, root, "messages").select("id", "source_key", "status"), "source_key", "id").select("source_key", "id", "status")


def table_counts(spark, root):
    parts = [table(spark, root, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("messages", "upstream_candidates", "candidate_pairs", "companies", "binance_tradfi_instruments")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def snapshot_summary(spark, root):
    return table(spark, root, "messages").agg(F.count("*").alias("messages"), F.count_if(F.expr("trim(text) <> ''")).alias("valid"), F.countDistinct("source_key").alias("keys"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def page_of_messages(spark, root):
    return table(spark, root, "messages").where("trim(text) <> ''").orderBy(F.desc("id")).offset(40).limit(25).select("id", "source_type")


def queries():
    return {f.__name__: f for f in (envelope_flatten, extract_text, source_type, record_projection, record_key, record_key_event, event_candidates, heartbeat_filter, message_time, nonblank_messages, source_backfill, normalize_dedup, language_dist, epoch_ms, synthetic_time, save_messages_dedup, candidates_dedup, insert_or_ignore, latest_delivery, table_counts, snapshot_summary, page_of_messages)}


_EVENTS = """raw as (select id message_id, raw_event_json::json j from messages where json_valid(raw_event_json)),
opened as (select *, case json_type(j) when 'OBJECT' then case when coalesce(json_type(j, '$.data'), 'NULL') <> 'NULL' then j->'$.data' else j->'$.result' end end inner_ from raw),
whole as (select message_id, case when json_type(inner_) in ('OBJECT', 'ARRAY') then j end outer_, case json_type(j) when 'ARRAY' then j when 'OBJECT' then case when json_type(inner_) in ('OBJECT', 'ARRAY') then inner_ when json_extract_string(j, '$.type') in ('ping', 'pong') and not list_has_any(json_keys(j), ['data', 'result']) then null else j end end w from opened),
items as (select message_id, outer_, unnest(case json_type(w) when 'ARRAY' then json_extract(w, '$[*]') else [w] end) e, generate_subscripts(case json_type(w) when 'ARRAY' then json_extract(w, '$[*]') else [w] end, 1) - 1 place from whole where w is not null),
events_ as (select * from items where json_type(e) = 'OBJECT')"""
_OWN = "case when outer_ is not null and not list_contains(json_keys(e), '{0}') then outer_->'$.{0}' else e->'$.{0}' end"
_CANDIDATES = _EVENTS + f""",
offered as (select message_id, place, e, {_OWN.format('stoks')} a, {_OWN.format('stocks')} b from events_),
chosen as (select message_id, place, e, case when coalesce(json_type(a), 'NULL') <> 'NULL' then a when coalesce(json_type(b), 'NULL') <> 'NULL' then b when coalesce(json_extract_string(e, '$.stocker_code'), '') <> '' then e end v from offered),
unquoted as (select message_id, place, case when json_type(v) = 'VARCHAR' then case when json_valid(json_extract_string(v, '$')) then json_extract_string(v, '$')::json end else v end v from chosen),
each_ as (select message_id, place, unnest(case json_type(v) when 'ARRAY' then json_extract(v, '$[*]') when 'OBJECT' then [v] end) c from unquoted)"""
_F = "json_extract_string(e, '$.{}')"
_ID = "coalesce(nullif(json_extract_string(e, '$.id_str'), ''), nullif(json_extract_string(e, '$.id'), ''), nullif(json_extract_string(e, '$.new_id'), ''), '')"
_URL = "coalesce(nullif(json_extract_string(e, '$.item_url'), ''), nullif(json_extract_string(e, '$.content_url'), ''), '')"
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8194) || chr(8201) || chr(8239) || chr(8287) || chr(12288)"
_TEXTS = "list_filter([" + ", ".join(f"trim(case when json_type(e, '$.{f}') = 'VARCHAR' then json_extract_string(e, '$.{f}') else '' end, {_WS})" for f in I.TEXT_FIELDS) + "], lambda x: lower(x) not in ('', 'null', '{}', '[]'))"


FORM = "trim(regexp_replace(regexp_replace(lower(regexp_replace(text, 'https?://[^ \\t\\n\\f\\r\\x0b]+', '', 'g')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}]+', ' ', 'g'), ' +', ' ', 'g'))"


def oracle_sql():
    return {
        "envelope_flatten": f"with {_EVENTS} select message_id, place, {_ID} source_id from events_",
        "extract_text": f"with {_EVENTS}, t as (select message_id, place, {_TEXTS} x from events_) select message_id, place, coalesce(array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), chr(10)), '') as text from t",
        "source_type": f"""with {_EVENTS} select message_id, place, case when trim(coalesce({_F.format('source_type')}, '')) <> '' then lower(trim({_F.format('source_type')})) when contains(lower({_URL}), 'twitter.com/') or contains(lower({_URL}), 'x.com/') or coalesce({_F.format('id_str')}, '') <> '' then 'twitter' when coalesce({_F.format('content_url')}, '') <> '' or coalesce({_F.format('types')}, '') <> '' then 'news' else 'unknown' end source_type from events_""",
        "record_projection": f"with {_EVENTS} select message_id, place, {_ID} source_id, {_URL} source_url, coalesce({_F.format('create_time')}, '') published_at from events_",
        "record_key": f"with {_EVENTS} select message_id, place, case when trim({_ID}, {_WS}) <> '' then 'id:' || trim({_ID}, {_WS}) when e::varchar <> '{{}}' then 'event' else 'text:' || sha256('') end source_key from events_",
        "event_candidates": f"with {_CANDIDATES} select stocker_code, count(*) n from (select distinct message_id, place, coalesce(json_extract_string(c, '$.stocker_id'), '') id, upper(trim(coalesce(json_extract_string(c, '$.stocker_code'), ''), {_WS})) stocker_code, trim(coalesce(json_extract_string(c, '$.stocker_name'), ''), {_WS}) name from each_ where json_type(c) = 'OBJECT') where id || stocker_code || name <> '' group by stocker_code",
        "heartbeat_filter": "select case when event_id % 4 = 3 then 'inner' else 'whole' end kind, count(*) n from events where not (event_id % 3 = 0 and event_id % 4 = 0) group by 1",
        "message_time": "select id, coalesce(nullif(trim(published_at), ''), received_at) message_time from messages",
        "nonblank_messages": "select id, length(text) characters from messages where trim(text) <> ''",
        "source_backfill": "select case when source_type = 'unknown' and (contains(lower(source_url), 'twitter.com/') or contains(lower(source_url), 'x.com/')) then 'twitter' else source_type end source_type, count(*) n from messages group by 1",
        "normalize_dedup": f"select id, {FORM} form from messages where text is not null",
        "language_dist": "select case when regexp_matches(text, '[一-鿿]') then 'cn' else 'en' end as language, count(*) n from messages where trim(text) <> '' group by 1",
        "epoch_ms": "select id, strftime(make_timestamp(published_at::bigint * 1000), '%Y-%m-%dT%H:%M:%S') iso from messages where regexp_full_match(published_at, '[0-9]{13}')",
        "save_messages_dedup": "select source_key, min(id) id from messages group by source_key",
        "candidates_dedup": "select message_id, count(*) n from (select distinct message_id, coalesce(stocker_id, '') a, coalesce(stocker_code, '') b, coalesce(stocker_name, '') c from upstream_candidates) group by message_id",
        "insert_or_ignore": "select source_key, min(id) id from messages where source_key not in (select source_key from messages where id in (select message_id from candidate_pairs)) group by source_key",
        "latest_delivery": "select source_key, id, status from (select *, row_number() over (partition by source_key order by id desc) rn from messages) where rn = 1",
        "table_counts": " union all ".join(f"select '{t}' table_name, count(*) n from {t}" for t in ("messages", "upstream_candidates", "candidate_pairs", "companies", "binance_tradfi_instruments")),
        "snapshot_summary": "select count(*) messages, count(*) filter (where trim(text) <> '') valid, count(distinct source_key) keys, min(created_at) first_at, max(created_at) last_at from messages",
        "page_of_messages": "select id, source_type from messages where trim(text) <> '' order by id desc limit 25 offset 40",
    }
