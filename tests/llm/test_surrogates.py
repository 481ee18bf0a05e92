import datetime
import random
import re

import pytest

from brindle.llm import privacy as P

S = b"secret"


def check(number):
    return "10X98765432"[sum(int(c) * 2 ** (17 - i) for i, c in enumerate(number[:17])) % 11]


@pytest.mark.parametrize("kind,make", [
    ("phone", lambda i: f"+44 20 7946 {i:04d}"), ("phone", lambda i: f"1380000{i:04d}"), ("email", lambda i: f"user{i}@mail.test"), ("street_address", lambda i: f"{i + 1} Elm Road"), ("person_name", lambda i: f"An{'bcdfghjklm'[i // 200]}{'aeiou'[i % 5]}{'npqrstvwxz'[i // 5 % 10]}{'aeiou'[i // 50 % 4]} Lee"), ("id_number", lambda i: f"219-{i // 100 + 10}-{i % 100 + 1000}"),
])
def test_distinct_items_have_distinct_surrogates_in_the_whole_corpus(kind, make):
    made = {make(i) for i in range(2000)}
    new = {P.surrogate(x, kind, S) for x in made}
    assert len(new) == len(made) and all(P.surrogate(x, kind, S) != x for x in made)


def test_permutation_is_one_cycle():
    for size in (2, 3, 10, 100, 1000):
        p, x, seen = P.Permutation(size, S, "t"), 0, []
        for _ in range(size):
            x = p.next(x)
            seen.append(x)
        assert sorted(seen) == list(range(size)) and x == 0


def test_citizen_numbers_stay_valid():
    rng = random.Random(1)
    made = set()
    for _ in range(300):
        body = f"11{rng.randrange(10**4):04d}{datetime.date(1950, 1, 1) + datetime.timedelta(days=rng.randrange(20000)):%Y%m%d}{rng.randrange(1000):03d}"
        made.add(body + check(body))
    new = {x: P.surrogate(x, "id_number", S) for x in made}
    assert len(set(new.values())) == len(made)
    for x, y in new.items():
        assert y[:2] == "11" and y[17] == check(y) and datetime.datetime.strptime(y[6:14], "%Y%m%d") and int(y[16]) % 2 == int(x[16]) % 2 and (y[17] == "X") == (x[17] == "X")
        assert [k for _, _, k in P.items(f"号 {y}。")] == ["id_number"]
    assert P.surrogate("110105 19491231 002X", "id_number", S).replace(" ", "") == P.surrogate("11010519491231002X", "id_number", S)


def test_parts_that_tell_the_type_stay():
    for item, kind, pattern in [("+44 20 7946 0756", "phone", r"\+44 2\d \d{4} \d{4}"), ("+86 138 0000 8605", "phone", r"\+86 1\d\d \d{4} \d{4}"), ("ann.lee@foo.co.uk", "email", r"[a-z]{3}\.[a-z]{3}@[a-z]{3}\.[a-z]{2}\.uk"), ("ann at foo dot test", "email", r"[a-z]{3} at [a-z]{3} dot test"), ("12 Elm Street", "street_address", r"[1-9]\d [A-Z][a-z]{2} Street"), ("晗汀路205弄18号", "street_address", r"[一-鿿]{2}路[1-9]\d\d弄[1-9]\d号"), ("Maria Lopez", "person_name", r"[A-Z][aeiou][a-z]{2}a [A-Z][a-z]{4}"), ("祁听微", "person_name", rf"[{P._FAMILY}][一-鿿]{{2}}")]:
        assert re.fullmatch(pattern, P.surrogate(item, kind, S)), P.surrogate(item, kind, S)


def test_spellings_and_short_forms_of_one_person():
    a, b = P.surrogate("JOHN SMITH", "person_name", S), P.surrogate("John Smith", "person_name", S)
    assert a == b.upper() and b.istitle() and P.surrogate("Smith, John", "person_name", S) == ", ".join(reversed(b.split()))
    new = P.replace("Signed, Tom Ford. Then Ford left, and Fordham stayed.", "surrogate", S)
    name = re.match(r"Signed, (\w+) (\w+)\.", new)
    assert new.endswith(f"Then {name[2]} left, and Fordham stayed.") and name[2] != "Ford"


@pytest.mark.parametrize("text,want", [
    ("Please contact Maria Lopez tomorrow", ["marialopez"]), ("My neighbour John Smith lives in Paris", ["johnsmith"]), ("王小明昨天来了", ["王小明"]), ("He told Anna B. Weber-Lang all", ["annabweberlang"]), ("我的同事李雷说", ["李雷"]),
    ("John Deere Inc rose", ["johndeere"][:0]), ("They contact New customers", []), ("call Center", []), ("Ring +33 1 42 68 53 00 now", ["33142685300"]), ("高端仓库今天开业", []),
])
def test_items_without_a_fixed_phrase(text, want):
    assert [P.key_of(text[a:b]) for a, b, _ in P.items(text)] == want
