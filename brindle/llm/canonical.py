"""Freely typed codes and names to the entries of a reference list, by a prefix-filter set-similarity join.

A typed name is reduced to mention words; a mention and a reference word are sets of letter pairs, ordered by their rarity in
the reference list. Only the rare prefixes are joined; sizes and positions bound the overlap before the exact Jaccard
similarity is computed. Because a listed and an unlisted firm can differ by one word, an exact
check follows: the mention is at most one edit from the reference word, and a line of business, where one is typed, is that of
the entry. Of the entries left the most similar is kept; where two are equally similar, the value stays unmatched. A code that is a listed one in any notation decides by itself.

The typed values are reduced to their distinct pairs before any of this, so a value typed by a third of all rows costs one.
The reference list is broadcast only while it is small (BROADCAST_ROWS); beyond, the joins are shuffled.

Cases: null and blank values say nothing; rows that name nothing, or several listed instruments alike, are UNMATCHED; repeated
rows get one result each; an empty reference list leaves every row UNMATCHED.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm import codepoints as C
from brindle.session import bounded, checkpoint

UNMATCHED, SIMILARITY, BROADCAST_ROWS = "UNMATCHED", 1 / 3, 200_000
# Legal forms and share classes; texts that stand for no instrument; exchanges meant by a prefix or suffix.
LEGAL = "INC CORP CORPORATION PLC LTD LIMITED HOLDINGS HOLDING GROUP CO COMPANY DE ADR ADS CLASS ORD ORDINARY SHS SHARES COMMON STOCK ETF A B C H W".split()
LEGAL_CN = "股份|公司|集团|控股|有限"
NOTHING = "N/A NA INDEX TEST USDT NULL NONE NAN UNKNOWN".split()
EXCHANGES = {
    "NASDAQ": ["NASDAQ"], "NYSE": ["NYSE"], "US": ["NASDAQ", "NYSE", "US"], "HK": ["HKEX"], "HKEX": ["HKEX"], "SH": ["SSE"], "SSE": ["SSE"], "SS": ["SSE"],
    "SZ": ["SZSE"], "SZSE": ["SZSE"], "KR": ["KRX"], "KRX": ["KRX"], "KS": ["KRX"], "O": ["NASDAQ"], "OQ": ["NASDAQ"], "N": ["NYSE"], "P": ["US", "NYSE"],
}
_BEFORE = "NASDAQ|NYSE|HKEX|SSE|SZSE|KRX|US|SH|SZ|HK|KR"
_AFTER = "OQ|O|N|P|US|HK|KS|KR|SZ|SH|SS"


def _clean(df: DataFrame) -> DataFrame:
    """Distinct typed pairs with both texts in their one form, upper case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [C.encode(*C.normal_form(*C.decode(b.column(i)))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *forms], names=["code", "name", "code_form", "name_form"])

    forms = df.mapInArrow(run, "code string, name string, code_form string, name_form string")
    tidy = lambda c: F.upper(F.trim(F.regexp_replace(F.translate(c, "：，；／．－＿（）", ":,;/.-_()"), r"\s+", " ")))
    return forms.select("code", "name", tidy("code_form").alias("code_form"), tidy("name_form").alias("name_form"))


def _pairs_of_letters(word: Column) -> Column:
    """Set of letter pairs of a word with an edge mark at each end, repeats numbered."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    raw = F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(F.sequence(F.lit(1), F.size(raw)), lambda i: F.concat(F.element_at(raw, i), F.size(F.filter(F.slice(raw, F.lit(1), i), lambda x: x == F.element_at(raw, i))).cast("string")))


def _one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, replacement or swap of neighbours."""
    swapped = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (letters(a) == letters(b)) & (swapped == 2))


def _words(name: Column) -> Column:
    return F.array_except(F.filter(F.split(F.translate(name, "'’`", ""), "[^A-Z]+"), lambda w: w != ""), F.array(*map(F.lit, LEGAL)))


def _reference(instruments: DataFrame) -> DataFrame:
    """One row per listed code: ticker, exchange, contracts, first word, line of business, Chinese name."""
    i = instruments.where("canonical_code is not null").groupBy("canonical_code").agg(F.min("ticker").alias("ticker"), F.collect_set("contract_symbol").alias("contracts"), F.max("name_en").alias("name_en"), F.max(F.trim("name_cn")).alias("name_cn"))
    words = _words(F.upper(F.coalesce("name_en", F.lit(""))))
    return i.select("canonical_code", F.coalesce("ticker", F.substring_index("canonical_code", ":", -1)).alias("ticker"), F.substring_index("canonical_code", ":", 1).alias("exchange"), "contracts", F.get(words, F.lit(0)).alias("first"), F.array_join(F.slice(words, 2, 9), " ").alias("line"), F.nullif("name_cn", F.lit("")).alias("name_cn"))


def _parsed_codes(typed: DataFrame) -> DataFrame:
    """Adds ticker (null where the code says nothing) and the exchanges that its notation allows (null: any)."""
    c = F.regexp_replace("code_form", r"^[$#\s]+", "")
    before = rf"^({_BEFORE})(?:[:/ ._\-]+([A-Z0-9]+)|([0-9]+))$"
    after = rf"^([A-Z0-9]+)\.({_AFTER})$"
    table = F.create_map(*[x for k, v in EXCHANGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    says = c.rlike("[A-Z0-9]") & ~c.isin(*NOTHING) & ~c.rlike("^0+$")
    ticker = F.when(c.rlike(before), F.concat(F.regexp_extract(c, before, 2), F.regexp_extract(c, before, 3))).when(c.rlike(after), F.regexp_extract(c, after, 1)).otherwise(F.regexp_replace(c, r"(?<=[A-Z0-9])USD[T1]$", ""))
    hint = F.when(c.rlike(before), table[F.regexp_extract(c, before, 1)]).when(c.rlike(after), table[F.regexp_extract(c, after, 2)])
    out = typed.withColumn("bare", F.when(says, c)).withColumn("ticker", F.when(says, ticker)).withColumn("hint", F.when(says, hint))
    short = F.col("ticker").rlike("^0[0-9]{4}$") & (F.col("hint").isNull() | F.array_contains("hint", "HKEX"))
    return out.withColumn("ticker", F.when(short, F.substring("ticker", 2, 4)).otherwise(F.col("ticker")))


def _by_code(typed: DataFrame, ref: DataFrame) -> DataFrame:
    """(code, name, listed): the listed codes that a typed code can denote."""
    r = ref.select(F.explode(F.array_distinct(F.concat(F.array(F.col("ticker")), "contracts"))).alias("sign"), "canonical_code", "exchange")
    t = typed.where("ticker is not null").select("code", "name", "hint", F.explode(F.array_distinct(F.array("ticker", "bare"))).alias("sign"))
    hit = t.join(bounded(r, BROADCAST_ROWS), "sign").where("hint is null or array_contains(hint, exchange)")
    return hit.groupBy("code", "name").agg(F.collect_set("canonical_code").alias("listed"))


def similar_words(typed: DataFrame, ref: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(word, first, jaccard) of distinct mention words (word) and reference words (first) of Jaccard similarity t or more.

    Prefix-filter join: tokens in the order of their rarity in the reference list; a word of n tokens is found by its first
    n - ceil(t n) + 1; sizes and positions bound the overlap before it is counted.
    """
    r = ref.select("first").distinct().withColumn("tokens", _pairs_of_letters(F.col("first")))
    rarity = r.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rarity = bounded(rarity, BROADCAST_ROWS)

    def ordered(df: DataFrame, word: str) -> DataFrame:
        """One row per prefix token: word, all tokens in order, size, position."""
        # outer, as the filter of a plain explode would be computed again before the distinct
        each = df.select(word, F.explode_outer("tokens").alias("token")).join(rarity, "token", "left").select(word, F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token").alias("o"))
        lists = each.groupBy(word).agg(F.array_sort(F.collect_list("o")).alias("o"))  # a word has few tokens
        n = F.size("o")
        return lists.select(word, F.col("o.token").alias("all"), n.alias("n"), F.posexplode(F.slice(F.col("o.token"), F.lit(1), (n - F.ceil(F.lit(t) * n - 1e-9) + 1).cast("int"))).alias("at", "token"))

    left = ordered(typed.select("word").distinct().withColumn("tokens", _pairs_of_letters(F.col("word"))), "word")
    right = ordered(r, "first").select("first", F.col("all").alias("all2"), F.col("n").alias("n2"), F.col("at").alias("at2"), "token")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("n") + F.col("n2")) - 1e-9)
    met = left.join(bounded(right, BROADCAST_ROWS), "token").where((F.col("n2") >= F.lit(t) * F.col("n")) & (F.col("n") >= F.lit(t) * F.col("n2")) & (1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) - 1 + F.least("at", "at2") >= need))
    both = F.size(F.array_intersect("all", "all2"))
    return met.dropDuplicates(["word", "first"]).select("word", "first", (both / (F.col("n") + F.col("n2") - both)).alias("jaccard")).where(F.col("jaccard") >= t)


def _by_name(typed: DataFrame, ref: DataFrame) -> DataFrame:
    """(code, name, canonical_code, ticker, level, jaccard): level 3 whole name, 2 first word without a line of business."""
    longest = 1 + (ref.select(F.max(F.greatest(F.length("first"), F.length("line")))).first()[0] or 0)  # a word beyond it is more than one edit from any
    lines = sorted({w for (line,) in ref.select("line").distinct().collect() for w in line.split()})  # words of the reference list's names
    known = F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>")
    ends = "|".join(lines) or "(?!)"
    n = F.regexp_replace("name_form", r"\([^)]*\)", " ")
    glued = F.regexp_replace(F.regexp_replace(n, rf"(?<=[A-Z]{{4}})(ETF)\b", " $1"), rf"(?<=[A-Z]{{4}})({ends})\b", " $1")
    words = F.filter(_words(glued), lambda w: F.length(w) <= longest)
    line_of = lambda w: F.get(F.filter(known, lambda s: (s == w) | ((F.length(w) >= 3) & (F.substring(s, 1, 1) == F.substring(w, 1, 1)) & F.rlike(s, F.concat(F.lit("^"), F.regexp_replace(w, "(.)", "$1.*"), F.lit("$"))))), F.lit(0))
    cn = F.regexp_replace(F.array_join(F.regexp_extract_all("name_form", F.lit("([一-鿿]+)"), 1), ""), rf"({LEGAL_CN})+$", "")
    t = typed.select("code", "name", words.alias("words"), cn.alias("cn")).withColumn("line_words", F.filter(F.transform("words", line_of), lambda x: x.isNotNull()))
    t = checkpoint(t.withColumn("mentions", F.filter("words", lambda w: line_of(w).isNull() & (F.length(w) >= 3))))
    # lines of business by the end of a Chinese name, from entries that have both names
    cn_lines = dict(sorted({(r["e"], r["line"]) for r in ref.where("name_cn is not null and line <> ''").select(F.substring("name_cn", 3, 9).alias("e"), "line").distinct().collect() if r["e"]}))
    cn_line = F.coalesce(*[F.when(F.col("cn").endswith(e), F.lit(x)) for e, x in sorted(cn_lines.items(), key=lambda p: -len(p[0]))], F.lit(None).cast("string")) if cn_lines else F.lit(None).cast("string")
    t = t.withColumn("line_words", F.array_distinct(F.concat("line_words", F.when(cn_line.isNotNull(), F.split(cn_line, " ")).otherwise(F.array().cast("array<string>")))))
    small = bounded(ref.select("canonical_code", "ticker", "first", "line", "name_cn"), BROADCAST_ROWS)
    whole = t.where("cn <> ''").join(small, F.col("cn") == F.col("name_cn")).select("code", "name", "canonical_code", "ticker", F.lit(3).alias("level"), F.lit(1.0).alias("jaccard"))
    mention = t.select("code", "name", "line_words", F.size("mentions").alias("said"), F.explode("mentions").alias("word"))
    alike = checkpoint(similar_words(mention, ref.where("length(first) >= 3")).where(_one_edit(F.col("word"), F.col("first"))))
    hit = mention.join(bounded(alike, BROADCAST_ROWS), "word").join(small, "first")
    same = F.size(F.array_intersect("line_words", F.split("line", " "))) > 0
    level = F.when(same, 3).when((F.size("line_words") == 0) & (F.col("said") == 1), 2)  # any other word is a line of business that no entry has
    return whole.union(hit.select("code", "name", "canonical_code", "ticker", level.alias("level"), "jaccard").where("level is not null"))


def map_to_canonical(rows: DataFrame, instruments: DataFrame, key: str = "id", code: str = "stocker_code", name: str = "stocker_name") -> DataFrame:
    """(key, canonical_code or UNMATCHED) of every row whose code, as it stands, is not in the list."""
    ref = checkpoint(_reference(instruments))
    flat = rows.select(F.col(key).alias("key"), F.col(code).alias("raw"), F.coalesce(F.col(code), F.lit("")).alias("code"), F.coalesce(F.col(name), F.lit("")).alias("name"))
    cases = flat.join(bounded(ref.select(F.col("canonical_code").alias("raw")), BROADCAST_ROWS), "raw", "left_anti").drop("raw")
    typed = checkpoint(_parsed_codes(_clean(cases.select("code", "name").distinct())))  # read several times
    codes = _by_code(typed, ref)
    near = F.translate(F.coalesce("t.ticker", F.lit("")), "01", "OI")
    names = _by_name(typed, ref).alias("n").join(typed.select("code", "name", "ticker").alias("t"), ["code", "name"])
    says = F.col("t.ticker").isNotNull() & ~F.col("t.ticker").rlike("^[0-9]{7,}$")
    meant = F.translate("n.ticker", "01", "OI")
    trusted = F.when(F.col("level") == 3, 3).when(~says, 2).when(_one_edit(near, meant) | (F.length(near) == F.length(meant)) & (F.array_sort(F.split(near, "")) == F.array_sort(F.split(meant, ""))), 2)
    names = names.select("code", "name", F.col("n.canonical_code").alias("canonical_code"), trusted.alias("trust"), F.col("level"), "jaccard")
    best = names.groupBy("code", "name").agg(
        *[F.array_distinct(F.collect_list(F.when(F.col("level") == k, F.col("canonical_code")))).alias(f"level{k}") for k in (3, 2)],
        *[F.collect_set(F.when((F.col("level") == k) & F.col("trust").isNotNull(), F.struct("jaccard", "canonical_code"))).alias(f"trust{k}") for k in (3, 2)],
    )  # at most the entries that share a first word
    none = F.array().cast("array<string>")
    best = typed.select("code", "name").join(codes, ["code", "name"], "left").join(best, ["code", "name"], "left")
    full = lambda c: F.coalesce(c, none)
    listed = full(F.col("listed"))
    most = lambda a: F.transform(F.filter(a, lambda x: x["jaccard"] == F.array_max(a)["jaccard"]), lambda x: x["canonical_code"])  # noqa: E731  the most similar
    nearest = [F.coalesce(most(F.col(f"trust{k}")), none) for k in (3, 2)]
    single = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    decided = F.coalesce(single(listed), *[single(F.array_intersect(listed, full(F.col(f"level{k}")))) for k in (3, 2)], F.when(F.size(listed) == 0, F.coalesce(single(nearest[0]), F.when(F.size(nearest[0]) == 0, single(nearest[1])))), F.lit(UNMATCHED))
    result = best.select("code", "name", decided.alias("canonical_code"))
    return cases.join(result, ["code", "name"]).select("key", "canonical_code")


def unmatched_values(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """(stocker_code, stocker_name, rows) of the typed values that were not matched."""
    found = map_to_canonical(rows, instruments).where(F.col("canonical_code") == UNMATCHED).select(F.col("key").alias("id"))
    return rows.join(found.distinct(), "id").groupBy("stocker_code", "stocker_name").agg(F.count("*").alias("rows"))
