import pytest

from brindle.llm.shapes import judge, shape_groups, stuffed_pages, units

SPAM = [
    "cheap, replica, sale, cheap, buy, sale, replica, cheap, sale, buy, cheap, sale, replica, buy, cheap, sale, free, sale, cheap, buy, buy, free, sale, cheap, cheap, buy, sale, free, cheap, buy, sale, cheap",
    "Why does the cache of row_a lose a page? " + "buy shoes Kenford; buy shoes Lisstead; " * 10, "\n".join(["cheap", "download", "case", "deal"] * 10), "tags = " + "#deal#shoes#dealshoes" * 10, "Testsieger Rabatt Tasche neu Uhr " * 10,
    "\n".join(f"coupon pills M red SKU-9560{i} 2{i}.99" for i in range(8)), "\n".join(f"* https://a.test/{i}" for i in range(8)), " ".join(f"[cheap bag](https://a.test/{i})" for i in range(8)), "优惠 官网批发 灯具 优惠 官网 灯具 批发 优惠 " * 6, "best outlet coupon free. best case flights outlet. " * 6,
]
STREWN = [
    "cups tickets and the cups fittings! rings tickets with our rings cups! tickets rings and the cups fittings! fittings tickets for the cups rings tickets in your fittings. rings cups to tickets fittings.",
    "carpet price in your carpet villa! price villa and the villa carpet price. villa bargain with our carpet bargain! bargain carpet for the villa price carpet in your bargain villa. price bargain with our villa carpet!",
    "Teppich Rabatt für die Teppich Vase! Rabatt Vase mit Teppich Rabatt Vase und Teppich! Vase Krediet für die Rabatt Teppich. Krediet Vase mit Rabatt Teppich für die Vase Krediet! Teppich Vase und Rabatt Krediet.",
    "地毯花瓶在优惠花瓶. 花瓶地毯的优惠地毯 地毯优惠和花瓶优惠! 优惠花瓶就选地毯花瓶. 地毯的花瓶优惠 花瓶优惠在地毯花瓶! 优惠地毯和花瓶地毯. 花瓶就选优惠地毯!",
    "The second reader of page_idle gives up before its buffer is drained, see also rack 4410.\ntickets cups to fittings rings. rings cups for the tickets fittings rings in your cups tickets! fittings cups with our rings tickets! cups fittings and the rings cups! rings tickets in your fittings cups. cups tickets with our rings fittings tickets for the cups! rings fittings and the cups rings! tickets to cups fittings rings.",
]
HONEST = [
    "My lathe stops whenever the belt is warm. I have cleaned the belt, swapped the switch and measured the coil, and the lathe still stops. Does the coil of this lathe need a new belt, or is the switch of the belt too weak for it?",
    "> The reader of the second shelf gives up before its own buffer has been drained.\n\nThe reader of the second shelf gives up before its own buffer has been drained.\nDid you ever try a larger one?",
    "| step | result |\n| first | ok |\n| second | ok |\n| third | failed |\nThe third step fails on my machine and I can't see why, as the log has nothing about it.",
]
HAM = [
    None, "", " \n", "Never mind, found it.", "Bitte Version nennen.", "See https://a.test/x for details.", "Why does it lose a page?\n\n```\n" + "2025-01-01 00:00:00 WARN a_b: c_d retry 1\n" * 20 + "```", "It fails.\n" + "import a_b.c_d\n" * 20,
    "Under\nthe\ndebugger,\nour\nbroken\ntimer\nrejects\neach\nvalue\nsince\nthe\nbuffer\nis\nreused\nand\nthat\nis\nodd", "nach dem neustart blockiert die warteschlange den letzten schlüssel und die sitzung verliert sonst alle umlaute", "The list:\n\n248,682,887,131\n752,1,2,3\n" * 5,
    "I have tried these:\n- the first one of them, which failed. http://a.test/1\n- the second, which was slow for us. http://a.test/2\n- a third that I do not like. http://a.test/3", "为什么索引切换冬令时后锁住旧令牌？重启之后，消息队列会误读最后一个键。" * 3,
]


@pytest.mark.parametrize("text", SPAM)
def test_stuffing(text):
    assert judge(text)[0]


@pytest.mark.parametrize("text", STREWN)
def test_key_words_with_function_words_strewn_in(text):
    assert judge(text)[0]


@pytest.mark.parametrize("text", [t for t in [*HAM, *HONEST] if t is not None])
def test_posts(text):
    assert not judge(text)[0]


def test_columns(spark):
    rows = [(i, t, 0) for i, t in enumerate(SPAM + HAM)] + [(900, "cheap sale buy " * 100000, 0), (0, SPAM[0], 0)]
    df = spark.createDataFrame(rows, "id long, text string, key int")
    got = sorted(r["key"] for r in stuffed_pages(df, "id", "text").collect())
    assert got == sorted([*range(len(SPAM)), 0, 900])
    assert stuffed_pages(df.limit(0), "id", "text").count() == 0


def test_groups_equal_a_plain_count(spark):
    texts = [t for t in SPAM + HAM if t]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {(r["kind"], r["shape"]): r["units"] for r in shape_groups(df, "text").collect()}
    want = {}
    for t in texts:
        for kind, shape, *_ in units(t):
            want[kind, shape] = want.get((kind, shape), 0) + 1
    assert got == want
