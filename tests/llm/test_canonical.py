import random

from pyspark.sql import functions as F

from brindle.llm.canonical import _pairs_of_letters, map_to_canonical, similar_words, unmatched_values

LISTED = [
    ("JRRUSDT", "JRR", "NASDAQ:JRR", "Jorpole Software Group Co., Ltd.", "钧朔软件"), ("TANTUSDT", "TANT", "NASDAQ:TANT", "Talthorn Materials Inc.", None), ("TANT2USDT", "TANT", "NYSE:TANT", "JORPORZELL BIOSYSTEMS INC /DE/", "隽旻生物"),
    ("TQQLUSDT", "TQQL", "NASDAQ:TQQL", "Talquill Financial", "钺珩金融"), ("TLLUSDT", "TLL", "NASDAQ:TLL", "Talquill Energy Inc.", ""), ("AUSDT", "8296", "HKEX:8296", "Ligate Robotics ETF", "岚昶机器人"),
]
CASES = [
    ("$JRR", None, "NASDAQ:JRR"), ("jrr.oq", "unknown", "NASDAQ:JRR"), ("ＪＲＲ", "", "NASDAQ:JRR"), ("NASDAQ：JRR", "-", "NASDAQ:JRR"), ("JRRUSDT", None, "NASDAQ:JRR"), ("us_JRR", None, "NASDAQ:JRR"), ("HK08296", None, "HKEX:8296"),
    ("", "Jropole Software", "NASDAQ:JRR"), (None, "SOFTWARE, JORPOLE", "NASDAQ:JRR"), ("JR R", "JorpoleSoftware", "NASDAQ:JRR"), ("未知", "钧朔软件-W", "NASDAQ:JRR"), ("N/A", "Jоrpоle Ntwks", "UNMATCHED"), ("1234567", "Jorpole", "NASDAQ:JRR"),
    ("TANT", "Talthorn Mat'ls", "NASDAQ:TANT"), ("TANT", "Jorporzell Biosystems", "NYSE:TANT"), ("TANT", None, "UNMATCHED"), ("TANTUSDT", "Jorporzell", "NYSE:TANT"), ("-", "Talquill", "UNMATCHED"), ("TLLL", "Talquill", "NASDAQ:TLL"), ("-", "Talquill Finl", "NASDAQ:TQQL"),
    ("NYSE:ABCD", "Jorpole", "UNMATCHED"), ("", "Jorpole Foods", "UNMATCHED"), ("USDT", "stable token", "UNMATCHED"), (None, None, "UNMATCHED"), ("000000", "", "UNMATCHED"), ("NYSE:JRR", "x", "UNMATCHED"), ("-", "Ligate Robotics", "HKEX:8296"), ("", "x" * 100000, "UNMATCHED"),
]


def frames(spark):
    ref = spark.createDataFrame([(*r, "stock") for r in LISTED], "contract_symbol string, ticker string, canonical_code string, name_en string, name_cn string, code string")
    rows = spark.createDataFrame([(i, c, n, 1) for i, (c, n, _) in enumerate(CASES)] + [(900, "NASDAQ:JRR", "Talquill", 1)], "id long, stocker_code string, stocker_name string, key int")
    return rows, ref


def test_cases(spark):
    rows, ref = frames(spark)
    got = {r["key"]: r["canonical_code"] for r in map_to_canonical(rows, ref).collect()}
    assert [got.get(i) for i in range(len(CASES))] == [c[2] for c in CASES] and len(got) == len(CASES)
    report = unmatched_values(rows.union(rows.where("id = 22").withColumn("id", F.lit(77))), ref).collect()
    assert {(r["stocker_code"], r["rows"]) for r in report} >= {("USDT", 2)}


def test_the_most_similar_entry_is_kept(spark):
    listed = [("AUSDT", "AA", "NYSE:AA", "Velmora Inc.", None, "stock"), ("BUSDT", "BB", "NYSE:BB", "Velmoro Inc.", None, "stock"), ("CUSDT", "CC", "NYSE:CC", "Tarnik", None, "stock"), ("DUSDT", "DD", "NYSE:DD", "Tarnik", None, "stock")]
    ref = spark.createDataFrame(listed, "contract_symbol string, ticker string, canonical_code string, name_en string, name_cn string, code string")
    rows = spark.createDataFrame([(1, "", "Velmora"), (2, "", "Velmoro"), (3, "", "Velmor"), (4, "", "Tarnik")], "id long, stocker_code string, stocker_name string")
    assert {r["key"]: r["canonical_code"] for r in map_to_canonical(rows, ref).collect()} == {1: "NYSE:AA", 2: "NYSE:BB", 3: "UNMATCHED", 4: "UNMATCHED"}


def test_empty(spark):
    rows, ref = frames(spark)
    assert map_to_canonical(rows.limit(0), ref).count() == 0
    assert {r["canonical_code"] for r in map_to_canonical(rows, ref.limit(0)).collect()} == {"UNMATCHED"}


def test_join_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ABCDE") for _ in range(rng.randrange(3, 9)))
    left, right = {word() for _ in range(120)}, {word() for _ in range(60)}
    typed, ref = spark.createDataFrame([(w,) for w in left], "word string"), spark.createDataFrame([(w,) for w in right], "first string")
    sets = {r["w"]: set(r["s"]) for r in spark.createDataFrame([(w,) for w in left | right], "w string").select("w", _pairs_of_letters(F.col("w")).alias("s")).collect()}
    want = {(a, b) for a in left for b in right if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 1 / 3 - 1e-12}
    assert {(r["word"], r["first"]) for r in similar_words(typed, ref).collect()} == want
