"""Queries of the registry and of mention matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from brindle.functions import text as T
from brindle.operators import matching as M, registry as R
from brindle.session import checkpoint, table


PATTERN_TICKERS = 5_000  # a registry has a few hundred numeric ones
HANDLES = 100_000


def registry(spark: SparkSession, root: str) -> DataFrame:
    return R.load_registry(table(spark, root, "companies"), table(spark, root, "binance_tradfi_instruments"))


def _terms(spark: SparkSession, root: str) -> DataFrame:
    """The terms as a table: they are counted before they are broadcast."""
    return checkpoint(R.terms(registry(spark, root)))


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return M.prepared(table(spark, root, "messages"))


def matches(spark: SparkSession, root: str) -> DataFrame:
    return M.identify(table(spark, root, "messages"), _terms(spark, root))


def registry_load(spark, root):
    m = R.manual_companies(table(spark, root, "companies"))
    return m.select("company_id", "company_name", "exchange", "ticker", *(F.array_join(c, "|").alias(c) for c in ("aliases", "brands", "negative_contexts")))


def master_scan(spark, root):
    return R.master_rows(table(spark, root, "binance_tradfi_instruments")).select("canonical_code", "market", "exchange", "ticker")


def auto_aliases(spark, root):
    m = R.master_rows(table(spark, root, "binance_tradfi_instruments"))
    return m.select("canonical_code", F.array_join(R.automatic_aliases(F.col("name_en"), F.col("name_cn")), "|").alias("aliases"))


def registry_merge(spark, root):
    r = registry(spark, root)
    return r.select("canonical_code", "company_id", "company_name", "exchange", "ticker", *(F.array_join(c, "|").alias(c) for c in ("aliases", "brands", "negative_contexts")))


def term_expansion(spark, root):
    return R.terms(registry(spark, root)).select("canonical_code", "keyword", "kind", "confidence")


def ticker_dim(spark, root):
    return R.ticker_codes(registry(spark, root))


def handle_map(spark, root):
    return R.handle_names(registry(spark, root))


def numeric_tickers(spark, root):
    return registry(spark, root).where("ticker rlike '^[0-9]+$'").select("ticker")


def candidate_profile(spark, root):
    return registry(spark, root).select("canonical_code", R.profile(F.col("company_name"), F.col("canonical_code"), F.col("aliases")).alias("profile"))


def active_by_type(spark, root):
    return table(spark, root, "binance_tradfi_instruments").where("active = 1").groupBy("asset_type").agg(F.count("*").alias("n"))


def instrument_filter(spark, root):
    i = table(spark, root, "binance_tradfi_instruments").where("quote_asset = 'USDT'")
    return i.select("market", "asset_type", "contract_symbol", (F.col("status") == "TRADING").cast("int").alias("trading"), F.row_number().over(W.orderBy("market", "asset_type", "contract_symbol")).alias("place"))


def classify_securities(spark, root):
    i = table(spark, root, "binance_tradfi_instruments")
    special = i.where("contract_symbol like '%2USDT'").select("base_asset", "asset_type", "exchange").distinct()
    funds = i.where("asset_type = 'etf'").select("base_asset", "exchange").distinct()
    listed = table(spark, root, "companies").groupBy("ticker").agg(F.max("exchange").alias("exchange"))
    contracts = i.select("contract_symbol", "base_asset", F.when(F.col("market") == "KR", "COMMODITY").otherwise(F.col("underlying_type")).alias("underlying_type"))
    return R.classify(contracts, special, funds, listed).select("contract_symbol", "rule", "asset_type", "exchange")


def upsert_securities(spark, root):
    """The master's later half merged into its earlier half, with Chinese names kept where the new ones are empty."""
    i = table(spark, root, "binance_tradfi_instruments").groupBy("canonical_code").agg(F.max("name_en").alias("name_en"), F.max("name_cn").alias("name_cn"), F.max("active").alias("active"))
    old = i.where("canonical_code < 'NYSE:M'").withColumn("name_cn", F.concat(F.coalesce("name_cn", F.lit("")), F.lit("旧")))
    new = i.where("canonical_code > 'NASDAQ:M'")
    return R.upsert(old, new, ["canonical_code"], keep_if_empty=("name_cn",), reset={"active": F.lit(0)})


def keyword_hits(spark, root):
    return M.term_hits(_texts(spark, root), _terms(spark, root).where("kind <> 'ticker'")).select("message_id", "canonical_code", "keyword", "kind")


def ticker_match(spark, root):
    return M.term_hits(_texts(spark, root), _terms(spark, root).where("kind = 'ticker'")).select("message_id", "canonical_code", "keyword")


def negative_context_veto(spark, root):
    hits = M.term_hits(_texts(spark, root), _terms(spark, root))
    veto = hits.where("kind = 'negative'").select("message_id", "canonical_code").distinct()
    return hits.where("kind <> 'negative'").select("message_id", "canonical_code").distinct().join(veto, ["message_id", "canonical_code"], "left_anti")


def identify_matches(spark, root):
    return matches(spark, root).drop("place")


def best_mention(spark, root):
    return matches(spark, root).groupBy("match_type").agg(F.count("*").alias("n"), F.countDistinct("message_id").alias("messages"), F.sum(F.length("mention")).alias("characters"))


def match_order(spark, root):
    w = W.partitionBy("message_id").orderBy(F.desc("confidence"), "place", "canonical_code")
    return matches(spark, root).select("message_id", "canonical_code", F.row_number().over(w).alias("place"))


def folded_matches(spark, root):
    f = M.folded(matches(spark, root))
    return f.select("message_id", F.array_join("codes", ",").alias("codes"), F.array_join("mentions", ",").alias("mentions"))


def sanitize_text(spark, root):
    numbers = [r["ticker"] for r in numeric_tickers(spark, root).where("length(ticker) >= 6").limit(PATTERN_TICKERS + 1).collect()]
    if len(numbers) > PATTERN_TICKERS:
        raise ValueError("too many numeric tickers for one pattern")
    names = checkpoint(handle_map(spark, root))
    if names.limit(HANDLES + 1).count() > HANDLES:
        raise ValueError("too many handles for one map")
    handles = names.agg(F.map_from_entries(F.collect_list(F.struct("handle", "company_name"))).alias("handles"))
    return table(spark, root, "messages").where("text is not null").crossJoin(F.broadcast(handles)).select(F.col("id").alias("message_id"), T.sanitise(F.col("text"), numbers, F.col("handles")).alias("text"))


def queries():
    return {f.__name__: f for f in (registry_load, master_scan, auto_aliases, registry_merge, term_expansion, ticker_dim, handle_map, numeric_tickers, candidate_profile, active_by_type, instrument_filter, classify_securities, upsert_securities, keyword_hits, ticker_match, negative_context_veto, identify_matches, best_mention, match_order, folded_matches, sanitize_text)}


_SPLIT = "list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"
_MASTER = "master as (select canonical_code, max(market) market, max(exchange) exchange, max(ticker) ticker, max(name_en) name_en, max(name_cn) name_cn from binance_tradfi_instruments where mapper_candidate = 1 and asset_type = 'stock' group by canonical_code)"
_AUTO = """auto as (select *, trim(regexp_replace(trim(regexp_replace(coalesce(name_en, ''), '[,.]', '', 'g')), '\\s+(Inc|Corp|Corporation|Co|Ltd|PLC|N\\s*V|S\\s*p\\s*A)$', '', 'i')) plain from master),
aliased as (select *, list_filter([trim(coalesce(name_en, '')), trim(coalesce(name_cn, '')), case when length(plain) >= 4 and lower(plain) <> lower(coalesce(name_en, '')) then plain end], lambda x: coalesce(x, '') <> '') raw from auto),
named as (select canonical_code, market, exchange, ticker, name_en, name_cn, list_filter(raw, lambda x, i: list_position(raw, x) = i) auto_aliases from aliased)"""
_LAST = "last as (select * from (select *, row_number() over (partition by ticker order by market desc, exchange desc, canonical_code desc) rn from named) where rn = 1)"
_MANUAL = f"manual as (select row_number() over (order by company_id) - 1 ord, company_id, company_name, exchange, ticker, {_SPLIT.format(c='aliases')} aliases, {_SPLIT.format(c='brands')} brands, {_SPLIT.format(c='negative_contexts')} negative_contexts from companies)"
_REG = f"""{_MASTER}, {_AUTO}, {_LAST}, {_MANUAL},
both_ as (select coalesce(l.exchange, c.exchange) exchange, coalesce(l.ticker, c.ticker) ticker, coalesce(c.company_id, trim(regexp_replace(lower(l.canonical_code), '[^a-z0-9]+', '_', 'g'), '_')) company_id,
 coalesce(c.company_name, nullif(l.name_cn, ''), nullif(l.name_en, ''), l.ticker) company_name, list_concat(coalesce(c.aliases, []), coalesce(l.auto_aliases, [])) raw, coalesce(c.brands, []) brands, coalesce(c.negative_contexts, []) negative_contexts,
 row_number() over (order by l.canonical_code is null, coalesce(l.market, ''), coalesce(l.exchange, ''), coalesce(l.ticker, c.ticker), coalesce(c.ord, 0)) place
 from last l full outer join manual c on l.ticker = c.ticker),
registry as (select exchange || ':' || ticker canonical_code, company_id, company_name, exchange, ticker, list_filter(raw, lambda x, i: list_position(raw, x) = i) aliases, brands, negative_contexts, place from both_)"""
_TERMS = f"""{_REG},
terms as (select canonical_code, unnest(aliases) keyword, 'alias' kind, 0.98 confidence, generate_subscripts(aliases, 1) - 1 term_ord, place from registry
 union all select canonical_code, unnest(brands), 'brand', 0.90, 1000 + generate_subscripts(brands, 1) - 1, place from registry
 union all select canonical_code, unnest(negative_contexts), 'negative', null, 2000 + generate_subscripts(negative_contexts, 1) - 1, place from registry
 union all select canonical_code, ticker, 'ticker', 0.99, 3000, place from registry)"""
_HITS = f"""{_TERMS},
raw_texts as (select id message_id, regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(160) || chr(12288)), 'https?://[^ \\t\\n\\r]+', ' ', 'g') text from messages where trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13) || chr(160) || chr(12288)) <> ''),
texts as materialized (select *, lower(text) low from raw_texts),
escaped as materialized (select *, lower(keyword) small, regexp_matches(keyword, '[一-鿿]') cjk, regexp_replace(keyword, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g') e from terms where keyword <> ''),
met as materialized (select t.message_id, t.text, e.* from texts t join escaped e on contains(t.low, e.small)),
hits as (select * exclude (text, small, cjk, e) from met where case when cjk then true when kind = 'ticker' then regexp_matches(text, case when length(keyword) > 1 then '(^|[^A-Za-z0-9])' else '(^|[^A-Za-z0-9])\\$' end || e || '([^A-Za-z0-9]|$)') else regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || e || '([^A-Za-z0-9]|$)') end)"""
_MATCHES = f"""{_HITS},
kept as (select * from hits h where kind <> 'negative' and not exists (select 1 from hits n where n.kind = 'negative' and n.message_id = h.message_id and n.canonical_code = h.canonical_code)),
matches as (select message_id, canonical_code, keyword mention, kind match_type, confidence::double confidence, min(place) over (partition by message_id, canonical_code) place from (select *, row_number() over (partition by message_id, canonical_code order by confidence desc, length(keyword) desc, term_ord) rn from kept) where rn = 1)"""


def oracle_sql():
    lists = "array_to_string(aliases, '|') aliases, array_to_string(brands, '|') brands, array_to_string(negative_contexts, '|') negative_contexts"
    return {
        "registry_load": f"with {_MANUAL} select company_id, company_name, exchange, ticker, {lists} from manual",
        "master_scan": f"with {_MASTER} select canonical_code, market, exchange, ticker from master",
        "auto_aliases": f"with {_MASTER}, {_AUTO} select canonical_code, array_to_string(auto_aliases, '|') aliases from named",
        "registry_merge": f"with {_REG} select canonical_code, company_id, company_name, exchange, ticker, {lists} from registry",
        "term_expansion": f"with {_TERMS} select canonical_code, keyword, kind, confidence::double confidence from terms where keyword <> ''",
        "ticker_dim": f"with {_REG} select ticker, max_by(canonical_code, place) canonical_code from registry group by ticker",
        "handle_map": f"with {_REG}, each as (select place, company_name, regexp_replace(lower(unnest(list_concat([ticker, company_name], aliases, brands))), '[^a-z0-9]', '', 'g') handle from registry) select handle, min_by(company_name, place) company_name from each where length(handle) >= 2 group by handle",
        "numeric_tickers": f"with {_REG} select ticker from registry where regexp_full_match(ticker, '[0-9]+')",
        "candidate_profile": f"with {_REG} select canonical_code, company_name || ' | ' || canonical_code || ' | aliases: ' || array_to_string(aliases[1:5], ', ') profile from registry",
        "active_by_type": "select asset_type, count(*) n from binance_tradfi_instruments where active = 1 group by asset_type",
        "instrument_filter": "select market, asset_type, contract_symbol, (status = 'TRADING')::int trading, row_number() over (order by market, asset_type, contract_symbol) place from binance_tradfi_instruments where quote_asset = 'USDT'",
        "classify_securities": """with sp as (select distinct base_asset, asset_type, exchange from binance_tradfi_instruments where contract_symbol like '%2USDT'), fu as (select distinct base_asset, exchange from binance_tradfi_instruments where asset_type = 'etf'), li as (select ticker, max(exchange) exchange from companies group by ticker)
 select i.contract_symbol, case when i.market = 'KR' or i.underlying_type = 'COMMODITY' then 'commodity' when sp.base_asset is not null then 'special' when fu.base_asset is not null then 'fund' when li.ticker is not null then 'listed' else 'unknown' end rule,
 case when i.market = 'KR' or i.underlying_type = 'COMMODITY' then 'commodity' when sp.base_asset is not null then sp.asset_type when fu.base_asset is not null then 'etf' when li.ticker is not null then 'stock' else 'unknown_equity' end asset_type,
 case when i.market = 'KR' or i.underlying_type = 'COMMODITY' then '' when sp.base_asset is not null then sp.exchange when fu.base_asset is not null then fu.exchange when li.ticker is not null then li.exchange else '' end exchange
 from binance_tradfi_instruments i left join sp on sp.base_asset = i.base_asset left join fu on fu.base_asset = i.base_asset left join li on li.ticker = i.base_asset""",
        "upsert_securities": """with i as (select canonical_code, max(name_en) name_en, max(name_cn) name_cn, max(active) active from binance_tradfi_instruments group by canonical_code), o as (select canonical_code, name_en, coalesce(name_cn, '') || '旧' name_cn, active from i where canonical_code < 'NYSE:M'), n as (select * from i where canonical_code > 'NASDAQ:M')
 select coalesce(n.canonical_code, o.canonical_code) canonical_code, case when n.canonical_code is null then o.name_en else n.name_en end name_en, case when n.canonical_code is null then o.name_cn when coalesce(n.name_cn, '') = '' then coalesce(nullif(o.name_cn, ''), n.name_cn) else n.name_cn end name_cn, case when n.canonical_code is null then 0 else n.active end active from o full outer join n on o.canonical_code = n.canonical_code""",
        "keyword_hits": f"with {_HITS} select message_id, canonical_code, keyword, kind from hits where kind <> 'ticker'",
        "ticker_match": f"with {_HITS} select message_id, canonical_code, keyword from hits where kind = 'ticker'",
        "negative_context_veto": f"with {_MATCHES} select distinct message_id, canonical_code from kept",
        "identify_matches": f"with {_MATCHES} select message_id, canonical_code, mention, match_type, confidence from matches",
        "best_mention": f"with {_MATCHES} select match_type, count(*) n, count(distinct message_id) messages, sum(length(mention))::bigint characters from matches group by match_type",
        "match_order": f"with {_MATCHES} select message_id, canonical_code, row_number() over (partition by message_id order by confidence desc, matches.place, canonical_code) place from matches",
        "folded_matches": f"with {_MATCHES} select message_id, string_agg(canonical_code, ',' order by confidence desc, place) codes, string_agg(mention, ',' order by confidence desc, place) mentions from matches group by message_id",
    }
