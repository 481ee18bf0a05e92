import pytest

from brindle.operators import matching as M, registry as R

COMPANIES = [
    ("apple", "苹果公司", "NASDAQ", "AAPL", "苹果公司|苹果|Apple", "iPhone|iPad", "水果|红富士|custard apple"), ("nvidia", "英伟达", "NASDAQ", "NVDA", "英伟达|NVIDIA", "CUDA", ""),
    ("citi", "花旗", "NYSE", "C", "花旗|Citigroup", None, None), ("inc", "英赛特", "NASDAQ", "INC", " Incyte | ", "", ""), ("berk", "伯克希尔", "NYSE", "BRK.B", "A股之王|Été & Fils", "", "coin flip"),
]
CASES = [
    ("英伟达发布了新芯片", {"NASDAQ:NVDA": ("英伟达", "alias")}), ("iPhone销量创下新高", {"NASDAQ:AAPL": ("iPhone", "brand")}), ("Vitamin C and V-shaped recovery", {}), ("$C rose", {"NYSE:C": ("C", "ticker")}), ("US$C rose", {}), ("-nvda", {}),
    ("红富士苹果丰收", {}), ("custard apple", {}), ("incomplete", {}), ("INC. up", {"NASDAQ:INC": ("INC", "ticker")}), ("https://x.test/NVDA only", {}), ("BRKXB", {}), ("BRK.B $BRK.B", {"NYSE:BRK.B": ("BRK.B", "ticker")}), ("apple nvidia", {"NASDAQ:AAPL": ("Apple", "alias"), "NASDAQ:NVDA": ("NVIDIA", "alias")}),
    ("a股之王来了", {"NYSE:BRK.B": ("A股之王", "alias")}), ("chez ÉTÉ & FILS", {"NYSE:BRK.B": ("Été & Fils", "alias")}), ("", {}), (None, {}), ("  ", {}), ("NVDA NVIDIA", {"NASDAQ:NVDA": ("NVDA", "ticker")}), ("x" * 100000 + " CUDA", {"NASDAQ:NVDA": ("CUDA", "brand")}),
]


@pytest.fixture(scope="module")
def terms(spark):
    raw = spark.createDataFrame(COMPANIES, "company_id string, company_name string, exchange string, ticker string, aliases string, brands string, negative_contexts string")
    return R.terms(R.merge_registry(R.manual_companies(raw), raw.limit(0).selectExpr("'' canonical_code", "'' market", "exchange", "ticker", "'' name_en", "'' name_cn")))


def test_golden_mentions(spark, terms, monkeypatch):
    df = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(CASES)], "id long, text string, keyword int")
    got = {}
    for r in M.identify(df, terms).collect():
        got.setdefault(r["message_id"], {})[r["canonical_code"]] = (r["mention"], r["match_type"])
    assert [got.get(i, {}) for i in range(len(CASES))] == [want for _, want in CASES]
    monkeypatch.setattr(M, "BROADCAST_TERMS", 3)  # terms too many to broadcast
    assert sorted(map(tuple, M.identify(df, terms).select("message_id", "canonical_code", "mention").collect())) == sorted((i, c, m) for i, x in got.items() for c, (m, _) in x.items())
    assert M.identify(df.limit(0), terms).count() == 0 and M.identify(df, terms.limit(0)).count() == 0


def test_merge_and_upsert(spark):
    raw = spark.createDataFrame([("a", "A", "NYSE", "WMT", "x|y", "b", ""), ("z", "Z", "HKEX", "9", "", "", "")], "company_id string, company_name string, exchange string, ticker string, aliases string, brands string, negative_contexts string")
    master = spark.createDataFrame([("NASDAQ:WMT", "US", "NASDAQ", "WMT", "Walmart, Inc.", ""), ("NYSE:NEW", "US", "NYSE", "NEW", "New Co", "新")], "canonical_code string, market string, exchange string, ticker string, name_en string, name_cn string")
    rows = {r["ticker"]: r for r in R.merge_registry(R.manual_companies(raw), master).collect()}
    assert rows["WMT"]["canonical_code"] == "NASDAQ:WMT" and rows["WMT"]["aliases"] == ["x", "y", "Walmart, Inc.", "Walmart"] and rows["WMT"]["company_id"] == "a"
    assert rows["NEW"]["company_id"] == "nyse_new" and rows["NEW"]["company_name"] == "新" and rows["9"]["canonical_code"] == "HKEX:9"
    old = spark.createDataFrame([("a", "甲", 1), ("b", "乙", 1)], "k string, cn string, active int")
    new = spark.createDataFrame([("b", "", 1), ("c", None, 1)], "k string, cn string, active int")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, R.upsert(old, new, ["k"], ("cn",), {"active": F.lit(0)}).collect())) == [("a", "甲", 0), ("b", "乙", 1), ("c", None, 1)]
