"""Deeply nested semi-structured records to flat, linked tables by structural variants.

A bottom-up tree automaton gives every JSON value a state: leaves have their type, an array the set of its elements'
states, an object the set of its (key, state) pairs. The state of an item object is its structural variant; the state below
its alias key, which the item's state names, is final in one typed subtype (`form`) and so routes the item there: each subtype
has a reader of its own. All items share the supertype columns (origin, parent_id, item_path, container_path, code, name,
variant, form), so subtype tables join back to their parents on (origin, parent_id, item_path).

JSON held in a string counts as if it stood there unquoted, at any number of levels. Cases: null, blank, cut off or otherwise
invalid text gives no row; records of any depth are read; an item without aliases gives one row with alias_no 0 and ''; null
and blank aliases are not counted; an alias object counts by its `name`; repeated keys: the last one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ITEM_KEY, ALIAS_KEY, NAME_KEY = "stocker_code", "aliases", "name"
FORMS = ("absent", "null", "text", "texts", "objects", "nested", "mixed")
SCHEMA = "origin string, parent_id long, item_path string, container_path string, code string, name string, variant long, form string, alias_no long, alias string"


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


_decoder = json.JSONDecoder(parse_constant=_refuse)


def decode(text: str):
    """The JSON value of a text; ValueError where it isn't valid."""
    try:
        return _decoder.decode(text)
    except RecursionError:
        return decode_deep(text)


_SPACE, _SCALAR = re.compile(r"[ \t\n\r]*"), re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


def decode_deep(text: str):
    """As `decode`, for texts nested deeper than the stack: open containers are kept in a list."""
    at, n = _SPACE.match(text).end(), len(text)
    opened: list[tuple[object, str | None]] = []  # container, key under which it stands
    done: object = None
    while True:
        c = text[at : at + 1]
        key = None
        if c in ("{", "["):
            inside = _SPACE.match(text, at + 1).end()
            opened.append(({} if c == "{" else [], None))
            if text[inside : inside + 1] == ("}" if c == "{" else "]"):
                done, at = opened.pop()[0], inside + 1
            elif c == "[":
                at = inside
                continue
            else:
                key, at = _key(text, inside)
                opened[-1] = (opened[-1][0], key)
                continue
        elif c == '"':
            done, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            done, at = _decoder.decode(m.group()), m.end()
        else:
            raise ValueError("not JSON")
        while True:  # a value is complete: put it where it belongs, and close what ends with it
            at = _SPACE.match(text, at).end()
            if not opened:
                if at < n:
                    raise ValueError("not JSON")
                return done
            box, key = opened[-1]
            if isinstance(box, dict):
                box[key] = done
            else:
                box.append(done)
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = _SPACE.match(text, at).end()
                if isinstance(box, dict):
                    key, at = _key(text, at)
                    opened[-1] = (box, key)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("not JSON")
            done = opened.pop()[0]


def _key(text: str, at: int) -> tuple[str, int]:
    """Key at a place and the place of its value."""
    if text[at : at + 1] != '"':
        raise ValueError("not JSON")
    key, at = json.decoder.scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("not JSON")
    return key, _SPACE.match(text, at + 1).end()


def unquote(value):
    """A string that holds a JSON object or array, however often it was quoted, as that value; anything else as it is."""
    if not isinstance(value, str):
        return value
    inner = value
    while isinstance(inner, str):
        s = inner.strip()
        if s[:1] not in ("{", "[", '"') or len(s) < 2:
            return value
        try:
            inner = decode(s)
        except ValueError:
            return value
    return inner if isinstance(inner, (dict, list)) else value


class TreeAutomaton:
    """Interns the states of JSON values. Equal shapes have equal states in every process: a state is a 64-bit hash of its term.

    `form` names the subtype in which a state is final, `below` the states under the keys of an object's state.
    """

    def __init__(self) -> None:
        self.known: dict[object, int] = {}
        self.form: dict[int, str] = {}
        self.below: dict[int, dict[str, int]] = {}

    def _state(self, step: str, term: object) -> int:
        if (s := self.known.get((step, term))) is None:
            if len(self.known) > 200_000:  # bounds the memory of one task; states don't depend on it, and living ones are met again
                self.known.clear()
            s = self.known[step, term] = int.from_bytes(hashlib.blake2b(repr((step, term)).encode(), digest_size=8).digest(), "big", signed=True)
            if step == "object":
                self.form[s], self.below[s] = "objects", dict(term)
            elif step == "array":
                kinds = {{"objects": "objects", "null": "null", "text": "texts"}.get(self.form[x], "nested") for x in term} - {"null"}
                self.form[s] = "texts" if not kinds else kinds.pop() if len(kinds) == 1 else "mixed"
            elif step == "quoted":
                self.form[s] = self.form[term]
            else:
                self.form[s] = "null" if term == "NoneType" else "text"
        return s

    def route(self, item: int) -> str:
        """Subtype of an item object by its state."""
        field = self.below[item].get(ALIAS_KEY)
        return "absent" if field is None else self.form[field]

    def classify(self, value) -> int:
        out: list[int] = []  # states of values whose parent isn't done
        stack: list[tuple[str, object]] = [("value", value)]
        while stack:
            step, v = stack.pop()
            if step == "value":
                if isinstance(v, dict):
                    stack.append(("object", list(v)))
                    stack.extend(("value", x) for x in reversed(v.values()))
                elif isinstance(v, list):
                    stack.append(("array", v))
                    stack.extend(("value", x) for x in v)
                elif isinstance(v, str) and isinstance(inner := unquote(v), (dict, list)):
                    stack += [("quoted", [inner]), ("value", inner)]
                else:
                    out.append(self._state("leaf", type(v).__name__))
                continue
            n = len(out) - len(v)
            states, out[n:] = out[n:], []
            term = tuple(sorted(zip(v, states))) if step == "object" else tuple(sorted(set(states))) if step == "array" else states[0]
            out.append(self._state(step, term))
        return out[0]


def aliases_of(value) -> list[str]:
    """Aliases in order, across nested arrays."""
    out: list[str] = []
    stack = [value]
    while stack:
        v = unquote(stack.pop())
        if isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            v = v.get(NAME_KEY)
            if isinstance(v, (list, dict)):
                stack.append(v)
            elif v is not None:
                stack_text = v if isinstance(v, str) else json.dumps(v)
                if stack_text.strip():
                    out.append(stack_text)
        elif v is not None:
            text = v if isinstance(v, str) else json.dumps(v)
            if text.strip():
                out.append(text)
    return out


def _texts(value) -> list[str]:
    """Reader of the subtype `texts`: a list of texts and other scalars."""
    value = unquote(value)
    return [x for x in (v if isinstance(v, str) else json.dumps(v) for v in value if v is not None) if x.strip()]


READERS = {"absent": lambda _: [], "null": lambda _: [], "texts": _texts}  # any other form: aliases_of


def items_of(value) -> Iterator[tuple[str, str, dict]]:
    """(path, path of the container, object) of every item, in document order."""
    stack = [("$", "", value)]
    while stack:
        path, container, v = stack.pop()
        v = unquote(v)
        if isinstance(v, dict):
            if ITEM_KEY in v:
                yield path, container, v
            stack.extend((f"{path}.{k}", path, x) for k, x in reversed(v.items()) if isinstance(x, (dict, list, str)))
        elif isinstance(v, list):
            stack.extend((f"{path}[{i}]", path, x) for i, x in reversed(list(enumerate(v))) if isinstance(x, (dict, list, str)))


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def flatten_items(df: DataFrame, key: str, column: str, origin: str, bare_aliases: bool = False) -> DataFrame:
    """One row per alias of every item in a JSON text column, in the supertype columns plus (alias_no, alias).

    With `bare_aliases` the column holds an alias field itself: its path is `$`, and one without aliases gives no row.
    Other columns of `df` are not read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or not (bare_aliases or ITEM_KEY in text or "\\u" in text):
                    continue
                try:
                    value = decode(text)
                except ValueError:
                    continue
                if bare_aliases:
                    value = unquote(value)
                    found = [("$", "", None, None, value)]
                else:
                    found = [(p, c, v, v.get(ALIAS_KEY), None) for p, c, v in items_of(value)]
                for path, container, item, field, bare in found:
                    variant = automaton.classify(bare if item is None else item)
                    form = automaton.form[variant] if item is None else automaton.route(variant)
                    names = READERS.get(form, aliases_of)(bare if item is None else field)
                    if not names:
                        if item is None:
                            continue
                        names, first = [""], 0
                    else:
                        first = 1
                    code, name = (None, None) if item is None else (_text(item.get(ITEM_KEY)), _text(item.get("stocker_name")))
                    for no, alias in enumerate(names, first):
                        for col, x in zip(cols, (k, path, container, code, name, variant, form, no, alias)):
                            col.append(x)
            n = len(cols[0])
            clean = lambda xs: pa.array([x if x is None else x.encode("utf-8", "replace").decode() for x in xs], pa.string())  # noqa: E731  lone surrogates
            yield pa.RecordBatch.from_arrays(
                [pa.array([origin] * n, pa.string()), pa.array(cols[0], pa.int64()), clean(cols[1]), clean(cols[2]), clean(cols[3]), clean(cols[4]), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.int64()), clean(cols[8])],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return df.select(F.col(key).cast("long").alias("_k"), F.col(column).cast("string").alias("_j")).where("_j is not null").mapInArrow(run, SCHEMA)


def stock_items(messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """The items of events and candidates and the bare alias lists, as one supertype table."""
    return flatten_items(messages, "id", "raw_event_json", "event").unionByName(flatten_items(candidates, "id", "raw_candidate_json", "candidate")).unionByName(flatten_items(candidates, "id", "aliases_json", "aliases", bare_aliases=True))


def subtype_table(flat: DataFrame, form: str) -> DataFrame:
    """Typed table of one subtype: its keys to the supertype and its aliases."""
    return flat.where(F.col("form") == form).select("origin", "parent_id", "item_path", "alias_no", "alias")


def item_table(flat: DataFrame) -> DataFrame:
    """The supertype: one row per item with its parent link, variant and number of aliases."""
    keys = ["origin", "parent_id", "item_path", "container_path", "code", "name", "variant", "form"]
    return flat.groupBy(*keys).agg(F.max("alias_no").alias("aliases"))
