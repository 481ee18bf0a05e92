"""Personal information in free text: detection and keyed, type-consistent surrogates.

Detection runs on a shadow of the text in which look-alikes are ordinary letters and invisible characters are gone; spans are
mapped back, so that an item is reported as it stands. Patterns cover e-mail addresses (also written out with "at" and "dot"),
phone numbers, identity numbers, street addresses (house number first or last, and Chinese) and names of persons: in phrases
and after words that introduce a person, after titles, and with a common given name before a family name. An item inside a
longer one isn't counted.

Surrogates come from a keyed permutation of all items of one type and format: an item has one surrogate in the whole corpus
(coreference), two items never share one (distinctness), no item is its own, and nothing has to be stored or compared between
tasks for it. Digits become digits, vowels vowels, consonants consonants and ideographs ideographs of common use; case and
separators stay. Types stay consistent: a phone number keeps its country code and the kind of its prefix, an e-mail address its
top domain, an address its kind of street, a citizen number its province, the gender of its sequence, a date that exists and
a right check digit; social security numbers stay valid where they are. A name is mapped part by part, so that a family name
alone gets the surrogate it has within the full name, and its parts keep a final vowel, which shows gender in many languages;
Chinese names open with a family name. Later mentions by a found name's family name alone are replaced too.

Cases: null stays null and has no items; empty text stays empty; texts of any length are processed whole; repeated rows give
repeated results; of items with one key and type a row has one. An item of a single letter or digit, or with none that can
change, becomes its type in brackets.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm import codepoints as C
from brindle.session import widened

TYPES = ("email", "street_address", "id_number", "phone", "person_name")

_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s?[\[(]\s?at\s?[\])]\s?){_HOST}(?:{_DOT}{_HOST})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])|(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*\sat\s{_HOST}(?:\sdot\s{_HOST})+(?![A-Za-z0-9])", re.I)

# Kinds of streets.
_ROADS = "Street|St|Road|Rd|Avenue|Ave|Row|Lane|Ln|Mews|Court|Ct|Terrace|Blvd|Boulevard|Drive|Way|Close|Place|Pl|Square|Sq|Crescent|Gardens|Hill|Parade|Walk|Grove|Park|Quay|Alley"
_W = r"[A-Za-zÀ-ÖØ-öø-ÿ'’]"
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_À-ɏ.,#-])\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}}[A-Za-z]?)?,? (?:{_W}+ ){{1,3}}(?:{_ROADS})\b"
    rf"|(?<![A-Za-z0-9_À-ɏ])(?:{_W}{{3,}}(?:straße|strasse|weg|gasse|allee|platz|ufer|damm|ring)|{_W}{{3,}}[- ](?:Straße|Strasse|Weg|Allee|Platz)) \d{{1,4}} ?[a-z]?(?![A-Za-z0-9_À-ɏ-])"
    rf"|(?<![A-Za-z0-9_À-ɏ])(?:[Cc]alle|CALLE|[Aa]venida|AVENIDA|[Pp]laza|[Pp]aseo|[Rr]ue|RUE|[Bb]oulevard|[Vv]ia [A-Z]|[Vv]iale|[Rr]ua|[Ii]mpasse|[Qq]uai) (?:(?:de|del|de la|du|des|la|le|los|las) )?(?:{_W}+ ){{0,2}}?{_W}+,? \d{{1,4}}[a-z]?(?![A-Za-z0-9_À-ɏ-])"
    r"|(?:(?<=搬到)|(?<=寄往)|(?<=地址[:：])|(?<=住在)|(?<=位于)|(?<=送到)|(?<![一-鿿])|(?<=[至在往到]))[一-鿿]{1,6}?(?:大道|大街|街道|胡同|路|街|巷|道)\d{1,5}(?:弄\d{1,5})?(?:号院|号)(?:之\d+)?"
)

_MOTION = re.compile(r"(?:寄往|寄到|寄至|搬到|搬至|送到|送至|地址|住在|位于)?")

ID_NUMBER = re.compile(
    r"(?<![\d-])(?:\d{6}(?P<s>[ -]?)(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?P=s)\d{3}[\dXx])(?![\dA-Za-z]|-\d)"  # citizen number, 18 places
    r"|(?<![A-Za-z0-9_-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9_À-ɏ-])|(?<![A-Za-z0-9_.-])\d{3} \d{2} \d{4}(?![A-Za-z0-9_])"  # social security number
    r"|(?<![A-Za-z0-9])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9])"  # national insurance number
    r"|(?:(?<=ID )|(?<=SSN )|(?<=no\. )|(?<=number )|(?<=passport )|(?<=insurance )|(?<=证件:)|(?<=证件：)|(?<=护照)|(?<=证件号 ))[A-Z]{1,2}\d{7,8}(?![A-Za-z0-9])"  # passport, after a word that says so
    r"|(?<![A-Za-z0-9#$:/.-])(?:X\d{8}|Z[A-Z]\d{7})(?![A-Za-z0-9])"
)

PHONE = re.compile(
    r"(?<![A-Za-z0-9_.+#$/-])(?:"
    r"(?:\+1|001)[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:\+44|0044)[ .-]?(?:\(0\))?(?:20[ .-]?\d{4}[ .-]?\d{4}|\d{3,4}[ .-]?\d{3}[ .-]?\d{3,4})"
    r"|(?:\+86|0086)[ .-]?(?:1[3-9]\d[ .-]?\d{4}[ .-]?\d{4}|\(?\d{2,3}\)?[ .-]?\d{4}[ .-]?\d{4})"
    r"|(?:\+49|0049)[ .-]?\(?\d{2,4}\)?[ .-]?\d{4,5}[ .-]?\d{2,4}"
    r"|(?:\+[1-9]\d{0,2}[ .-]?|00[1-9]\d{0,2}[ .-])\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,5}"  # any other country code
    r"|\(\d{3,4}\) ?\d{3,4}[ .-]?\d{4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|\d{3} \d{3} \d{4}"
    r"|0\d{2,3}[ -]\d{4}[ -]?\d{4}|0\d{2,3}-\d{7,8}"
    r"|1[3-9]\d(?P<m>[ -]?)\d{4}(?P=m)\d{4}"
    r")(?![A-Za-z0-9_]|[-.]\d)"
)

_N = r"(?:[A-Z][a-zß-öø-ÿ'’]+(?:-[A-Z][a-z]+)?|[A-Z][A-Z'’-]+)"
_I = r"[A-Z]\.?"
NAME = rf"{_N}(?:, {_N}(?: {_I})?|(?: {_I}){{0,2}} {_N}|(?: {_N})? [A-Z]\.)"
TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Sir|Herr|Frau|Mme|Sra?|Rev)\.? )?"
# Words after which a capitalised pair is a firm's.
_FIRMS = "Inc|Corp|Corporation|Co|Ltd|PLC|LLC|Group|Holdings|Bank|Capital|Partners|Foundation|Institute|University|Hospital|Street|Road|Avenue"
_OPENINGS = r"\b[Ss]igned,|\bSIGNED,|\b[Tt]hanks to|\bTHANKS TO|\bI spoke with|\bI SPOKE WITH|\b[Aa]sk for|\bASK FOR|\b[Cc]omplaint by|\bCOMPLAINT BY|\b[Dd]ear|\b[Aa]ttn:?|\b[Rr]egards,|\b[Ss]incerely,"
_TITLES = "Dr|Mr|Mrs|Ms|Prof|Sir|Herr|Frau|Mme|Sra|Rev|DR|MR|MRS|MS|PROF"
# Common given names.
_GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Peter Hans Klaus Jürgen Wolfgang Stefan Andreas Carlos Juan José Luis Miguel Pedro Pablo Diego Pierre Jean Jacques Ivan Sergei Ahmed Mohammed Omar Ali "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Anna Anne Jane Maria Monika Ursula Petra Sabine Heike Carmen Lucia Sofia Isabel Ana Claire Marie Sophie Camille Olga Natalia Fatima Aisha Alice Julia Emma"
).split()
_INTRODUCES = r"contact|call|phoned|emailed|met|met with|spoke to|speak to|spoke with|neighbou?r|colleague|friend|boss|manager|wife|husband|brother|sister|daughter|son|cousin|uncle|aunt|landlord|tenant|named|patient|client"
PERSON = [
    re.compile(rf"\b(?:{_INTRODUCES}) {TITLE}(?P<n>[A-Z][a-zß-öø-ÿ'’]+(?: [A-Z]\.)? [A-Z][a-zß-öø-ÿ'’]+)(?![\w-])"),
    re.compile(rf"(?<![\w.@-])(?P<n>(?:{'|'.join(_GIVEN)})(?: [A-Z]\.)? [A-Z][a-zß-öø-ÿ'’]+(?:-[A-Z][a-z]+)?)(?![\w-]| (?:{_FIRMS})\b)"),
    re.compile(rf"(?:{_OPENINGS}) {TITLE}(?P<n>{NAME})"),
    re.compile(rf"(?<![\w.-])(?P<n>{NAME})(?= (?:resigned from the panel|RESIGNED FROM THE PANEL))"),
    re.compile(rf"\b(?:{_TITLES})\.? (?P<n>{NAME})"),
]
# Family names that open a Chinese name here; single ones first.
_FAMILY = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚程嵇邢滑裴陆荣翁荀羊於惠甄曲家封芮羿储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭厉戎祖武符刘景詹束龙叶幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙池乔阴鬱胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍郤璩桑桂濮牛寿通边扈燕冀郏浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东欧殳沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公佟冼"
PERSON_CN = [
    re.compile(r"(?:联系人|联络人|收件人|经办人)[:：]\s?(?P<n>[一-鿿]{2,4})(?![一-鿿])"),
    re.compile(r"(?<![一-鿿])署名[:：]?\s?(?P<n>[一-鿿]{2,3})(?![一-鿿])"),
    re.compile(rf"投资人(?P<n>[{_FAMILY}][一-鿿]{{1,2}}?)(?=表示不解|表示|称|说)"),
    re.compile(rf"(?P<n>[{_FAMILY}][一-鿿]{{1,2}}?)(?=女士|先生|小姐|老师|教授)"),
    re.compile(rf"(?:^|(?<=[。！？，；\s]))(?P<n>[{_FAMILY}][一-鿿]{{1,2}}?)(?=昨天|今天|明天|昨晚|今早|告诉我|给我打|打电话给|住在|来电说)"),
    re.compile(rf"(?:我叫|名叫|我的?(?:同事|朋友|邻居|妻子|丈夫|老板|经理))(?P<n>[{_FAMILY}][一-鿿]{{1,2}}?)(?=[，。、！？\s]|说|在|的|住|来|$)"),
]
_CUE = re.compile(rf"{_OPENINGS}|{_TITLES}|{_INTRODUCES}|{'|'.join(_GIVEN)}|昨天|今天|明天|昨晚|今早|告诉我|给我打|打电话给|住在|来电说|我叫|名叫|同事|朋友|邻居|妻子|丈夫|老板|经理|[@\d]|\b(?:at|AT)\b|\(at\)|\[at\]|[Ss]igned|SIGNED|[Tt]hanks|THANKS|spoke|SPOKE|[Aa]sk for|ASK FOR|[Cc]omplaint|COMPLAINT|resigned|RESIGNED|Dr|DR|Mr|MR|Ms|MS|Prof|PROF|[Dd]ear|[Aa]ttn|[Rr]egards|联系人|联络人|收件人|经办人|署名|投资人|女士|先生|小姐|老师|教授")


def key_of(item: str) -> str:
    """An item in lower case without anything but letters and digits of any script."""
    return "".join(c for c in item.lower() if c.isalnum())


def _add(out: list, kind: str, a: int, b: int) -> None:
    if b > a:
        out.append((a, b, kind))


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of the items of an ordinary text, without those inside another one, in order."""
    found: list[tuple[int, int, str]] = []
    if not _CUE.search(text):
        return found
    if "@" in text or "at" in text or "AT" in text:
        for m in EMAIL.finditer(text):
            if text[max(0, m.start() - 3) : m.start()] != "://":
                _add(found, "email", m.start(), m.end())
    if any(c.isdigit() for c in text):
        for m in ID_NUMBER.finditer(text):
            _add(found, "id_number", m.start(), m.end())
        for m in ADDRESS.finditer(text):
            _add(found, "street_address", m.start() + len(_MOTION.match(m.group()).group()), m.end())
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                _add(found, "phone", m.start(), m.end())
    for p in PERSON if text.isascii() or re.search("[A-Za-z]", text) else ():
        for m in p.finditer(text):
            _add(found, "person_name", *m.span("n"))
    for p in PERSON_CN if not text.isascii() else ():
        for m in p.finditer(text):
            _add(found, "person_name", *m.span("n"))
    rank = {t: i for i, t in enumerate(TYPES)}
    found.sort(key=lambda s: (rank[s[2]], s[0] - s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in found:
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


@functools.lru_cache(maxsize=1)
def _shadow_table() -> dict[int, str | None]:
    """One ordinary character, or none, for each character that stands in for one."""
    t = C.tables()
    out: dict[int, str | None] = {c: None for c in C.INVISIBLES}
    out |= {c: " " for c in C.SPACES} | {ord(a): b for a, b in C.LOOKALIKES.items()}
    for c in np.flatnonzero((t["kind"] == C.COMPAT) & (t["length"] == 1)):
        out[int(c)] = chr(t["flat"][t["start"][c]])
    return out


def items(text: str) -> list[tuple[int, int, str]]:
    """Spans of the items of a text as it stands."""
    table = _shadow_table()
    if text.isascii() or not any(ord(c) in table for c in text):
        return find(text)
    at = [i for i, c in enumerate(text) if table.get(ord(c), c) is not None]
    shadow = "".join(table.get(ord(text[i]), text[i]) for i in at)
    return [(at[a], at[b - 1] + 1, kind) for a, b, kind in find(shadow)]


_VOWELS, _CONSONANTS, _DIGITS = "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789"
_ACCENTED = ("àáâãäåèéêëìíîïòóôõöùúûü", "çñ")
# the ideographs of common use are the first level of GB 2312
_COMMON = "".join(bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF))
_FAMILY = "".join(dict.fromkeys(_FAMILY))
_ALPHABETS = (_VOWELS, _CONSONANTS, _DIGITS, *_ACCENTED, _COMMON)
_ALPHABET_OF = {c: a for a in reversed(_ALPHABETS) for c in a}
_STREET_WORDS = re.compile(rf"\b(?:{_ROADS}|calle|avenida|plaza|paseo|rue|boulevard|via|viale|rua|impasse|quai|de|del|la|du|des|le|los|las)\b|(?:straße|strasse|weg|gasse|allee|platz|ufer|damm|ring)\b|大道|大街|街道|胡同|号院|[路街巷道弄号]", re.I)
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())  # fixed values
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2029, 12, 31).toordinal()


class Permutation:
    """Keyed permutation of the numbers below `size` in one cycle: a Feistel network orders them, and each goes to the next."""

    def __init__(self, size: int, secret: bytes, tweak: str) -> None:
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask, self.base = (1 << self.half) - 1, hashlib.sha256(secret + b"|" + f"{tweak}|{size}".encode()).digest()

    def _f(self, i: int, x: int) -> int:
        n = (self.half + 7) // 8
        return int.from_bytes(hashlib.shake_256(self.base + bytes([i]) + x.to_bytes(n, "big")).digest(n), "big") & self.mask

    def _forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(6):
                a, b = b, a ^ self._f(i, b)
            x = a << self.half | b
            if x < self.size:
                return x

    def _backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(6)):
                a, b = b ^ self._f(i, a), a
            x = a << self.half | b
            if x < self.size:
                return x

    def next(self, x: int) -> int:
        return self._forward((self._backward(x) + 1) % self.size)


def _permuted(values: list[int], sizes: list[int], secret: bytes, tweak: str, alike) -> list[int]:
    """The next tuple of the cycle that `alike` accepts; it accepts the given one, so the cycle is one of those it accepts."""
    total = x = 0
    total = 1
    for v, n in zip(values, sizes):
        x, total = x * n + v, total * n
    p = Permutation(total, secret, tweak)
    for _ in range(100_000):
        y = x = p.next(x)
        out = []
        for n in reversed(sizes):
            y, v = divmod(y, n)
            out.append(v)
        out.reverse()
        if alike(out):
            return out
    raise ValueError("no surrogate of this kind")  # no predicate below accepts fewer than one in a thousand


def _letters(text: str, places: list[int], secret: bytes, tweak: str, alike=None) -> str:
    """`text` with the characters at `places` permuted, each within its alphabet."""
    alphabets = [_ALPHABET_OF[text[i].lower()] for i in places]
    if not places:
        return text

    def laid(out: list[int]) -> str:
        new = list(text)
        for i, a, v in zip(places, alphabets, out):
            new[i] = a[v].upper() if text[i].isupper() else a[v]
        return "".join(new)

    values = [a.index(text[i].lower()) for i, a in zip(places, alphabets)]
    return laid(_permuted(values, [len(a) for a in alphabets], secret, tweak, (lambda out: alike(laid(out))) if alike else lambda _: True))


def _check_digit(body: str) -> str:
    """Check character of the first 17 places of a citizen number (weights 2 ** (17 - i) modulo 11)."""
    return "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(body)) % 11]


def _citizen(digits: str, secret: bytes) -> str:
    """18 places: the province stays, the rest is permuted to a date that exists and a right check digit."""
    try:
        day = datetime.date(int(digits[6:10]), int(digits[10:12]), int(digits[12:14])).toordinal() - _FIRST_DAY
    except ValueError:
        day = -1
    if not 0 <= day <= _LAST_DAY - _FIRST_DAY:
        return _letters(digits, [*range(2, 17)], secret, "citizen")
    gender, ending = int(digits[16]) % 2, digits[17] in "Xx"

    def laid(v: list[int]) -> str:
        body = f"{digits[:2]}{v[0]:04d}{datetime.date.fromordinal(v[1] + _FIRST_DAY):%Y%m%d}{2 * v[2] + gender:03d}"
        return body + _check_digit(body)

    new = laid(_permuted([int(digits[2:6]), day, int(digits[14:17]) // 2], [10_000, _LAST_DAY - _FIRST_DAY + 1, 500], secret, "citizen", lambda v: (laid(v)[-1] == "X") == ending))
    return new[:-1] + (digits[17] if ending else new[-1])


def _social(text: str) -> bool:
    d = "".join(c for c in text if c.isdigit())
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _country_code(digits: str) -> int:
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3


def _name(item: str, secret: bytes) -> str:
    """Part by part. A part's permutation depends on nothing else, so a part has one surrogate wherever it stands."""

    def part(m: re.Match) -> str:
        w = m.group()
        if "一" <= w[0] <= "鿿":
            rest = _letters(w[1:], [i for i, c in enumerate(w[1:]) if c in _COMMON], secret, "given")
            return (_FAMILY[_permuted([_FAMILY.index(w[0])], [len(_FAMILY)], secret, "family", lambda _: True)[0]] if w[0] in _FAMILY else _letters(w[0], [0] if w[0] in _COMMON else [], secret, "opening")) + rest
        last = len(w) - 1 if len(w) > 2 and w[-1].lower() in _VOWELS else len(w)
        return _letters(w, [i for i in range(last) if w[i].lower() in _ALPHABET_OF], secret, "name")

    return re.sub(r"[^\W\d_]+", part, item)


@functools.lru_cache(maxsize=100_000)
def surrogate(item: str, kind: str, secret: bytes) -> str:
    """Replacement of an item: same type, script and format, by a keyed permutation."""
    places = [i for i, c in enumerate(item) if c.lower() in _ALPHABET_OF]
    digits = [i for i in places if item[i] in _DIGITS]
    if kind == "person_name":
        return _name(item, secret)
    if kind == "street_address":
        fixed = {i for m in _STREET_WORDS.finditer(item) for i in range(*m.span())}
        first = [i for i in digits if not i or item[i - 1] not in _DIGITS]
        return _letters(item, [i for i in places if i not in fixed], secret, kind, lambda new: all((new[i] == "0") == (item[i] == "0") for i in first))
    if kind == "phone":
        foreign = "+" in item[:2] or item.startswith("00")
        lead = (2 if item.startswith("00") else 0) + (_country_code("".join(item[i] for i in digits)[2 if item.startswith("00") else 0 :]) if foreign else 0)
        keep = lead + (1 if foreign or item[digits[0]] not in "01" else 2)  # and the digit that tells the kind of number
        return _letters(item, digits[keep:], secret, kind)
    if kind == "id_number":
        plain = "".join(item[i] for i in digits) + ("X" if item[-1] in "Xx" and len(digits) == 17 else "")
        if len(plain) == 18:
            new = iter(_citizen(plain, secret))
            return "".join(next(new) if c in _DIGITS or c in "Xx" else c for c in item)[: len(item) - 1] + (item[-1] if item[-1] in "Xx" else _citizen(plain, secret)[-1])
        if len(digits) == len(places) == 9:
            valid = _social(item)
            return _letters(item, digits, secret, "social", lambda new: _social(new) == valid)
        return _letters(item, digits, secret, kind)
    top = re.search(r"[A-Za-z]+$", item)
    words = {i for m in re.finditer(r"(?<![A-Za-z0-9])(?:at|dot)(?![A-Za-z0-9])", item, re.I) for i in range(*m.span())} if "@" not in item else set()
    return _letters(item, [i for i in places if i < (top.start() if top else len(item)) and i not in words], secret, kind)


def _mentions(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Later mentions of the persons found by a part of their name alone, of three letters or more (the family name, last or before a comma)."""
    parts = set()
    for a, b, kind in spans:
        if kind == "person_name" and "A" <= text[a] <= "Z":
            words = re.findall(r"[^\W\d_]+", text[a:b].partition(",")[0])
            if len(text[a:b].split()) > 1 and len(words[-1]) >= 3 and words[-1][:1].isupper():
                parts.add(words[-1])
    if not parts:
        return spans
    taken = spans[:]
    for m in re.finditer(rf"(?<![\w@.-])(?:{'|'.join(sorted(map(re.escape, parts), key=len, reverse=True))})(?![\w@-])", text):
        if all(m.end() <= a or m.start() >= b for a, b, _ in spans):
            taken.append((*m.span(), "person_name"))
    return sorted(taken)


def replace(text: str, mode: str, secret: bytes) -> str:
    """The text with each item replaced by a surrogate, or (mode "type") by its type in brackets."""
    spans = items(text)
    if not spans:
        return text
    out, last = [], 0
    for a, b, kind in _mentions(text, spans):
        new = f"[{kind.upper()}]" if mode == "type" else surrogate(text[a:b], kind, secret)
        if key_of(new) == key_of(text[a:b]):  # nothing in it can change
            new = f"[{kind.upper()}]"
        out += [text[last:a], new]
        last = b
    return "".join(out) + text[last:]


def find_items(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pii_type, pii_key): one row per distinct item of a row. One pass, no shuffle."""
    flat = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text")).where("text is not null")
    kind = dict(flat.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, types, keys = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for t, k in sorted({(t, key_of(text[a:z])) for a, z, t in items(text)}):
                    at.append(i)
                    types.append(t)
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(types, pa.string()), pa.array(keys, pa.string())], names=["key", "pii_type", "pii_key"])

    return widened(flat).mapInArrow(run, f"key {kind}, pii_type string, pii_key string")


def pseudonymise(df: DataFrame, key: str, column: str, secret: str, mode: str = "surrogate") -> DataFrame:
    """(key, text) with every item replaced. `mode` "type" gives typed placeholders instead of surrogates."""
    flat = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    kind = dict(flat.dtypes)["key"]
    raw = secret.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else replace(t, mode, raw) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return flat.mapInArrow(run, f"key {kind}, text string")
