"""The registry of companies: manual rules merged with the instrument master, and the terms it is matched by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brindle.functions.text import filled, keywords, ustrip

# Confidence of a term's kind; legal forms that an automatic alias goes without.
CONFIDENCE = {"alias": 0.98, "brand": 0.90, "ticker": 0.99}
LEGAL = r"(?i)\s+(?:Inc|Corp|Corporation|Co|Ltd|PLC|N\s*V|S\s*p\s*A)$"


def manual_companies(raw: DataFrame) -> DataFrame:
    """Manual rows with their lists as arrays and their order as `ord`."""
    order = F.row_number().over(W.orderBy("company_id")) - 1  # a registry is small; files have no row order of their own
    return raw.select(order.alias("ord"), "company_id", "company_name", "exchange", "ticker", *(keywords(F.col(c)).alias(c) for c in ("aliases", "brands", "negative_contexts")))


def master_rows(instruments: DataFrame) -> DataFrame:
    """Distinct stocks of the instrument master that are to be matched."""
    return instruments.where("mapper_candidate = 1 and asset_type = 'stock'").groupBy("canonical_code").agg(*(F.max(c).alias(c) for c in ("market", "exchange", "ticker", "name_en", "name_cn")))


def automatic_aliases(name_en: Column, name_cn: Column) -> Column:
    """Both names, and the English one without punctuation and legal form where that differs and has four characters."""
    en, cn = F.coalesce(name_en, F.lit("")), F.coalesce(name_cn, F.lit(""))
    plain = ustrip(F.regexp_replace(ustrip(F.regexp_replace(en, r"[,.]", "")), LEGAL, ""))
    simple = F.when((F.length(plain) >= 4) & (F.lower(plain) != F.lower(en)), plain)
    return F.array_distinct(F.filter(F.array(ustrip(en), ustrip(cn), simple), lambda x: F.coalesce(x, F.lit("")) != ""))


def merge_registry(manual: DataFrame, master: DataFrame) -> DataFrame:
    """Full outer merge by ticker: the master's exchange and both sides' aliases; the last master row of a ticker holds."""
    order = W.partitionBy("ticker").orderBy(F.desc("market"), F.desc("exchange"), F.desc("canonical_code"))
    m = master.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("ticker", F.col("canonical_code").alias("m_code"), F.col("market").alias("m_market"), F.col("exchange").alias("m_exchange"), "name_en", "name_cn")
    c = manual.select("ticker", *(F.col(x).alias(f"c_{x}") for x in ("ord", "company_id", "company_name", "exchange", "aliases", "brands", "negative_contexts")))
    none = F.array().cast("array<string>")
    both = m.join(c, "ticker", "full_outer")
    auto = F.when(F.col("m_code").isNotNull(), automatic_aliases(F.col("name_en"), F.col("name_cn"))).otherwise(none)
    slug = F.regexp_replace(F.regexp_replace(F.lower("m_code"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    exchange = F.coalesce("m_exchange", "c_exchange")
    return both.select(
        F.concat_ws(":", exchange, "ticker").alias("canonical_code"), F.coalesce("c_company_id", slug).alias("company_id"), F.coalesce("c_company_name", filled(F.col("name_cn"), F.col("name_en"), F.col("ticker"))).alias("company_name"),
        exchange.alias("exchange"), "ticker", F.array_distinct(F.concat(F.coalesce("c_aliases", none), auto)).alias("aliases"), F.coalesce("c_brands", none).alias("brands"), F.coalesce("c_negative_contexts", none).alias("negative_contexts"),
        F.struct(F.col("m_code").isNull().alias("late"), F.coalesce("m_market", F.lit("")).alias("market"), F.coalesce("m_exchange", F.lit("")).alias("exchange"), "ticker", F.coalesce("c_ord", F.lit(0)).alias("ord")).alias("place"),
    )


def load_registry(companies: DataFrame, instruments: DataFrame) -> DataFrame:
    return merge_registry(manual_companies(companies), master_rows(instruments))


def terms(registry: DataFrame) -> DataFrame:
    """One row per term: code, keyword, kind (alias, brand, negative, ticker), confidence, its order in the company's lists, and
    the company's place in the registry."""
    lists = [("aliases", "alias"), ("brands", "brand"), ("negative_contexts", "negative")]
    parts = [registry.select("canonical_code", "place", F.posexplode(c).alias("nth", "keyword"), F.lit(k).alias("kind"), F.lit(i).alias("list")) for i, (c, k) in enumerate(lists)]
    parts.append(registry.select("canonical_code", "place", F.lit(0).alias("nth"), F.col("ticker").alias("keyword"), F.lit("ticker").alias("kind"), F.lit(3).alias("list")))
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).where("keyword <> ''")
    confidence = F.create_map(*(x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))))
    return out.select("canonical_code", "keyword", "kind", confidence[F.col("kind")].alias("confidence"), (F.col("list") * 1000 + F.col("nth")).alias("term_ord"), "place")


def ticker_codes(registry: DataFrame) -> DataFrame:
    """ticker -> code; the last row of the registry's order holds."""
    return registry.groupBy("ticker").agg(F.max_by("canonical_code", F.struct("place", "canonical_code")).alias("canonical_code"))


def handle_names(registry: DataFrame) -> DataFrame:
    """Handle (letters and digits of a ticker, name, alias or brand) -> name of the first company of the registry that has it."""
    words = F.concat(F.array("ticker", "company_name"), "aliases", "brands")
    each = registry.select("place", "canonical_code", "company_name", F.explode(words).alias("w")).select("place", "canonical_code", "company_name", F.regexp_replace(F.lower("w"), "[^a-z0-9]", "").alias("handle"))
    return each.where("length(handle) >= 2").groupBy("handle").agg(F.min_by("company_name", F.struct("place", "canonical_code")).alias("company_name"))


def profile(name: Column, code: Column, aliases: Column) -> Column:
    return F.concat(name, F.lit(" | "), code, F.lit(" | aliases: "), F.array_join(F.slice(aliases, 1, 5), ", "))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_if_empty: tuple[str, ...] = (), reset: dict[str, Column] | None = None) -> DataFrame:
    """MERGE as one full outer join: new values win, except empty ones of `keep_if_empty`; rows only in `old` get `reset`."""
    reset = reset or {}
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    both = o.join(n, on, "full_outer")

    def value(c: str) -> Column:
        fresh, stale = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in keep_if_empty:
            fresh = F.when(F.coalesce(fresh, F.lit("")) == "", F.coalesce(F.nullif(stale, F.lit("")), fresh)).otherwise(fresh)
        return F.when(F.col("n._new"), fresh).otherwise(reset.get(c, stale)).alias(c)

    return both.select(*(value(c) for c in old.columns))


def classify(contracts: DataFrame, special: DataFrame, funds: DataFrame, listed: DataFrame) -> DataFrame:
    """Kind and exchange of each contract's base asset by precedence: commodity, special case, fund, listed stock, unknown."""
    s = F.broadcast(special.select("base_asset", F.struct(F.lit("special").alias("rule"), "asset_type", "exchange").alias("s")))
    f = F.broadcast(funds.select("base_asset", F.struct(F.lit("fund").alias("rule"), F.lit("etf").alias("asset_type"), "exchange").alias("f")))
    t = listed.select(F.col("ticker").alias("base_asset"), F.struct(F.lit("listed").alias("rule"), F.lit("stock").alias("asset_type"), "exchange").alias("t"))
    commodity = F.when(F.col("underlying_type") == "COMMODITY", F.struct(F.lit("commodity").alias("rule"), F.lit("commodity").alias("asset_type"), F.lit("").alias("exchange")))
    unknown = F.struct(F.lit("unknown").alias("rule"), F.lit("unknown_equity").alias("asset_type"), F.lit("").alias("exchange"))
    joined = contracts.join(s, "base_asset", "left").join(f, "base_asset", "left").join(t, "base_asset", "left")
    return joined.select(*contracts.columns, F.coalesce(commodity, "s", "f", "t", unknown).alias("d")).select(*contracts.columns, "d.*")
