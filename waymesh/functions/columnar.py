"""Structural indexes of JSON and XML over a whole batch of texts: no record is parsed by itself.

The texts of a batch lie in one Arrow buffer. Masks over its bytes find quotes, brackets and scalars; running sums give
the depth of each token, and one sort by depth its parent. Well-formedness is a condition on neighbouring tokens and on the
brackets' pairs, so it is tested for all records at once. What comes out are flat arrays: elements with the number of their
record, children with the number of their element, values as slices taken from the buffer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from waymesh.functions.markup import xml_elements


@dataclass
class Elements:
    """Elements of a batch and their children, flat: of_record and element ids; references and tags point to their element."""

    record: np.ndarray
    ids: pa.Array
    ref_element: np.ndarray
    ref_place: np.ndarray
    refs: pa.Array
    tag_element: np.ndarray
    tag_keys: pa.Array
    tag_values: pa.Array


def whole_numbers(texts: pa.Array) -> pa.Array:
    """INT64 of texts that are whole numbers in ASCII digits within 64 bits, white space around them allowed; else null."""
    trimmed = pc.ascii_trim_whitespace(texts)
    ok = pc.fill_null(pc.match_substring_regex(trimmed, r"^[+-]?[0-9]{1,19}$"), False)
    plain = pc.replace_substring_regex(pc.if_else(ok, trimmed, pa.scalar(None, pa.string())), r"^\+", "")
    wide = pc.cast(plain, pa.decimal128(20, 0)) if plain.null_count < len(plain) else pa.nulls(len(plain), pa.decimal128(20, 0))
    fits = pc.and_(pc.greater_equal(wide, pa.scalar(-(2**63), pa.int64()).cast(pa.decimal128(20, 0))), pc.less_equal(wide, pa.scalar(2**63 - 1, pa.int64()).cast(pa.decimal128(20, 0))))
    return pc.cast(pc.if_else(pc.fill_null(fits, False), wide, pa.scalar(None, pa.decimal128(20, 0))), pa.int64())


def numbers(texts: pa.Array) -> pa.Array:
    """DOUBLE of texts that are decimal numbers, white space around them allowed; else null."""
    trimmed = pc.ascii_trim_whitespace(texts)
    ok = pc.fill_null(pc.match_substring_regex(trimmed, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), False)
    plain = pc.replace_substring_regex(pc.if_else(ok, trimmed, pa.scalar(None, pa.string())), r"^\+", "")
    return pc.cast(plain, pa.float64())


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about limit bytes of the text column; a longer text is a part by itself."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < batch.num_rows:
        e = max(s + 1, int(np.searchsorted(size, (size[s - 1] if s else 0) + limit, "right")))
        yield batch.slice(s, e - s)
        s = e


def taken(array: pa.Array, at: np.ndarray) -> pa.Array:
    """Values at the places, null at -1."""
    return array.take(pa.array(at, mask=at < 0)) if len(array) else pa.nulls(len(at), array.type)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[start:end] as one array."""
    size = (end - start).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offset[:-1], size) + np.arange(offset[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offset of each text) of non-null texts, a line end after each."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    joined = pa.concat_arrays([joined]) if joined.offset else joined
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8) if joined.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[: offsets[-1]], offsets


def parents_of(level: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each token at its level the last opening token one level above and before it; -1 at level 0."""
    n = len(level)
    mark = np.flatnonzero(opens)
    key = np.concatenate([level, level[mark] + 1]) * np.int64(n + 1) + np.concatenate([np.arange(n), mark])
    order = np.argsort(key, kind="stable")
    source = np.concatenate([np.full(n, -1), mark])[order]
    last = np.maximum.accumulate(np.where(source >= 0, np.arange(len(order)), 0)) if len(order) else order
    out = np.empty(len(order), np.int64)
    out[order] = source[last]
    return np.where(level > 0, out[:n], -1)


# --- JSON ------------------------------------------------------------------------------------------------------------

_HEX, _ESCAPES, _STRUCTURE, _BLANK = (np.isin(np.arange(256), [*s]) for s in (b"0123456789abcdefABCDEF", b'"\\/bfnrtu', b"{}[]:,", b" \t\r\n"))
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_SCALAR_MARK = ord("s")


def _unescaped(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quotes that are not escaped, places of the bytes that follow an escaping backslash)."""
    quote, slash = data == ord('"'), data == ord("\\")
    if not slash.any():
        return quote, np.empty(0, np.int64)
    at = np.arange(len(data))
    begins = np.maximum.accumulate(np.where(slash & ~np.r_[False, slash[:-1]], at, 0))
    escaping = np.flatnonzero(slash & ((at - begins) % 2 == 0))
    after = escaping[escaping + 1 < len(data)] + 1
    quote[after] = False
    return quote, after


@dataclass
class JsonTokens:
    """Tokens of the well-formed texts of a batch: {, }, [, ], :, comma, string (as a quote) or scalar (as s)."""

    data: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    record: np.ndarray
    parent: np.ndarray
    is_key: np.ndarray
    closer: np.ndarray

    def texts(self, at: np.ndarray) -> pa.Array:
        """The values of tokens as texts: strings decoded, scalars and containers as they stand; null for null and for -1."""
        some = np.maximum(at, 0)
        kind, start, end = self.kind[some], self.start[some], self.end[some]
        box = (kind == ord("{")) | (kind == ord("["))
        end = np.where(box, self.end[np.maximum(self.closer[some], 0)], end)
        text = kind == ord('"')
        found = slices(self.data, start + text, end - text)
        null = (at < 0) | ((kind == _SCALAR_MARK) & (self.data[start] == ord("n")))
        found = pc.if_else(pa.array(~null), found, pa.scalar(None, pa.string()))
        coded = pc.and_(pa.array(text), pc.fill_null(pc.match_substring(found, "\\"), False))
        if pc.any(coded).as_py():
            raw = found.filter(coded).to_pylist()
            plain = [x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in json.loads("[" + ",".join(f'"{x}"' for x in raw) + "]")]
            found = pc.replace_with_mask(found, coded, pa.array(plain, pa.string()))
        return found


def json_tokens(texts: pa.Array) -> JsonTokens:
    """Tokens of the well-formed ones of the texts (null: none); record is the place of the text."""
    where = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    data, offsets = _buffer(texts.take(pa.array(where)))
    if len(where):  # a text with an open string ends here, so that quotes pair up in the others
        quote, _ = _unescaped(data)
        odd = np.add.reduceat(np.r_[quote, False].astype(np.int64), offsets[:-1]) % 2 == 1
        if odd.any():
            where = where[~odd]
            data, offsets = _buffer(texts.take(pa.array(where)))
    quote, after = _unescaped(data)
    inside = np.cumsum(quote, dtype=np.int32) % 2 == 1  # from the opening quote to before the closing one
    outside = ~inside
    structure = _STRUCTURE[data] & outside
    closing = quote & outside
    scalar = outside & ~(structure | _BLANK[data] | closing)
    begins = scalar & ~np.r_[False, scalar[:-1]]
    start = np.flatnonzero(structure | (quote & inside) | begins)
    kind = data[start].copy()
    kind[begins[start]] = _SCALAR_MARK
    end = start + 1
    end[kind == ord('"')] = np.flatnonzero(closing) + 1
    end[begins[start]] = np.flatnonzero(scalar & ~np.r_[scalar[1:], False]) + 1
    doc = np.searchsorted(offsets, start, "right") - 1

    bad = np.zeros(len(where), bool)
    in_text = lambda at: bad.__setitem__(np.searchsorted(offsets, at, "right") - 1, True)
    in_text(np.flatnonzero(inside & (data < 32)))
    if len(after):
        in_text(after[~_ESCAPES[data[after]]])
        u = after[data[after] == ord("u")]
        padded = np.r_[data, np.zeros(4, np.uint8)]
        in_text(u[~np.all([_HEX[padded[u + k]] for k in range(1, 5)], axis=0)])
    words = np.flatnonzero(kind == _SCALAR_MARK)
    fine = pc.match_substring_regex(slices(data, start[words], end[words]), _SCALAR).to_numpy(zero_copy_only=False) if len(words) else np.empty(0, bool)
    bad[doc[words[~fine]]] = True
    bad |= np.bincount(doc, minlength=len(where)) == 0
    opens, closes = (kind == ord("{")) | (kind == ord("[")), (kind == ord("}")) | (kind == ord("]"))
    depth = np.cumsum(opens.astype(np.int64) - closes)
    first = np.searchsorted(doc, np.arange(len(where)))
    base = np.r_[0, depth][first]
    bad[doc[depth - base[doc] < 0]] = True
    bad |= np.r_[0, depth][np.searchsorted(doc, np.arange(len(where)), "right")] != base

    keep = ~bad[doc]
    kind, start, end, doc, opens, closes = (x[keep] for x in (kind, start, end, doc, opens, closes))
    n = len(kind)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    parent = parents_of(depth - opens + closes, opens)  # of a closing bracket: its opening one
    bad = np.zeros(len(where), bool)
    up = np.maximum(parent, 0)
    bad[doc[closes & ((parent < 0) | (kind[up] + 2 != kind))]] = True
    in_object = (parent >= 0) & (kind[up] == ord("{"))
    new = np.r_[True, doc[1:] != doc[:-1]] if n else np.empty(0, bool)
    last = np.r_[new[1:], True] if n else new
    before = np.r_[np.uint8(0), kind[:-1]] if n else kind
    before = np.where(new, 0, before)
    text = kind == ord('"')
    is_key = text & in_object & ((before == ord("{")) | (before == ord(",")))
    value = opens | (text & ~is_key) | (kind == _SCALAR_MARK)
    done = closes | (text & ~is_key) | (kind == _SCALAR_MARK)  # a value ends here
    b_done = np.r_[False, done[:-1]] & ~new if n else done
    b_key = np.r_[False, is_key[:-1]] & ~new if n else done
    b_comma_list = (before == ord(",")) & ~in_object
    comma, colon = kind == ord(","), kind == ord(":")
    ok = np.select(
        [new, b_done, b_key, before == ord(":"), before == ord("{"), before == ord("["), b_comma_list],
        [value, (comma | closes) & (parent >= 0), colon, value, is_key | (kind == ord("}")), value | (kind == ord("]")), value],
        is_key,
    )
    ok = ok & (~last | (done & (depth == 0)))
    bad[doc[~ok]] = True
    keep = ~bad[doc]
    place = np.cumsum(keep) - 1
    kind, start, end, doc, parent, is_key, closes = (x[keep] for x in (kind, start, end, doc, parent, is_key, closes))
    parent = np.where(parent >= 0, place[np.maximum(parent, 0)], -1)
    closer = np.full(len(kind), -1)
    closer[parent[closes]] = np.flatnonzero(closes)
    return JsonTokens(data, kind, start, end, where[doc] if len(where) else doc, parent, is_key, closer)


def json_ways(texts: pa.Array) -> Elements:
    """Every object of type way, at any depth, of the well-formed texts, in their order.

    References are the list nodes, or the ref of the objects of nd (a list or a single one), nodes first; a null keeps its place.
    Tags are the object tags, or the k and v of the objects of tag or tags (a list or a single one); an object without k gives
    none. Of a key given twice in an object the last counts, and nothing below the others is found. A reference or tag
    value that is a list or an object is its JSON text as it stands.
    """
    t = json_tokens(texts)
    n = len(t.kind)
    key_at = np.flatnonzero(t.is_key)
    names = t.texts(key_at)
    codes = names.dictionary_encode()
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) if n else np.empty(0, np.int64)
    owner = t.parent[key_at]
    group = owner * np.int64(len(codes.dictionary) + 1) + code
    alive = np.ones(n, bool)
    unique = len(key_at) - 1 - np.unique(group[::-1], return_index=True)[1] if len(key_at) else key_at
    if len(unique) < len(key_at):  # values of keys given again later
        gone = np.ones(len(key_at), bool)
        gone[unique] = False
        a = key_at[gone]
        z = np.where(t.closer[a + 2] >= 0, t.closer[a + 2], a + 2)
        alive = np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(z + 1, minlength=n + 1)[: n + 1])[:n] == 0
    live = alive[key_at]
    word = {v: i for i, v in enumerate(codes.dictionary.to_pylist())}

    def member(name: str) -> np.ndarray:
        """The value token of the key of each object, else -1."""
        out = np.full(n, -1)
        hit = live & (code == word.get(name, -1))
        out[owner[hit]] = key_at[hit] + 2
        return out

    kind_of = member("type")
    typed = np.flatnonzero(kind_of >= 0)
    is_way = (t.kind[kind_of[typed]] == ord('"')) & pc.fill_null(pc.equal(t.texts(kind_of[typed]), "way"), False).to_numpy(zero_copy_only=False)
    way = typed[is_way]
    number = np.full(n + 1, -1)
    number[way] = np.arange(len(way))
    null = (t.kind == _SCALAR_MARK) & (t.data[t.start] == ord("n")) if n else np.empty(0, bool)
    starts = (t.kind == ord("{")) | (t.kind == ord("[")) | ((t.kind == ord('"')) & ~t.is_key) | (t.kind == _SCALAR_MARK)

    def items(name: str) -> tuple[np.ndarray, np.ndarray]:
        """(way, token) of the elements of a way's list, or of its single value; null is an empty list."""
        value = member(name)[way]
        have = np.flatnonzero(value >= 0)
        value = value[have]
        listed = t.kind[value] == ord("[")
        of = np.full(n, -1)
        of[value[listed]] = have[listed]
        inner = np.flatnonzero(starts & (t.parent >= 0) & (of[t.parent] >= 0)) if n else np.empty(0, np.int64)
        alone = ~listed & ~null[value]
        w, tok = np.r_[of[t.parent[inner]], have[alone]], np.r_[inner, value[alone]]
        order = np.lexsort((tok, w))
        return w[order], tok[order]

    ref = member("ref")
    w_parts, t_parts = zip(items("nodes"), items("nd"))
    w, tok = np.concatenate(w_parts), np.concatenate(t_parts)
    order = np.argsort(w, kind="stable")
    w, tok = w[order], tok[order]
    many = np.bincount(w, minlength=len(way))
    place = np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)
    tok = np.where(t.kind[tok] == ord("{"), ref[tok], tok) if n else tok

    of = np.full(n + 1, -1)
    plain = member("tags")[way]
    boxed = np.flatnonzero((plain >= 0) & (t.kind[np.maximum(plain, 0)] == ord("{"))) if n else np.empty(0, np.int64)
    of[plain[boxed]] = boxed
    mine = np.flatnonzero(live & (of[owner] >= 0))
    k_at, v_at, tag_way = [key_at[mine]], [key_at[mine] + 2], [of[owner[mine]]]
    k, v = member("k"), member("v")
    for name in ("tag", "tags"):
        tw, obj = items(name)
        use = (t.kind[obj] == ord("{")) & (k[obj] >= 0)
        if name == "tags":
            use &= t.kind[np.maximum(t.parent[obj], 0)] == ord("[")
        k_at.append(k[obj[use]])
        v_at.append(v[obj[use]])
        tag_way.append(tw[use])
    tag_way_ = np.concatenate(tag_way)
    order = np.argsort(tag_way_, kind="stable")
    ids = whole_numbers(t.texts(member("id")[way]))
    return Elements(t.record[way], ids, w, place, t.texts(tok), tag_way_[order], t.texts(np.concatenate(k_at)[order]), t.texts(np.concatenate(v_at)[order]))


# --- XML -------------------------------------------------------------------------------------------------------------

_NAME = r"[A-Za-z_:][A-Za-z0-9_:.\-]*"
_ENTITY = r"&(?:lt|gt|amp|quot|apos|#(?:9|10|13|3[2-9]|[4-9][0-9]|[1-9][0-9]{2,3}|[1-4][0-9]{4})|#x(?:[9aAdD]|[2-9a-fA-F][0-9a-fA-F]|[1-9a-fA-F][0-9a-fA-F]{2}|[1-9aAbBcC][0-9a-fA-F]{3}));"
_CHAR = r"[^<>&\"'\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]"
_DECLARATION = r"<\?xml version=(?:\"1\.0\"|'1\.0')(?: encoding=(?:\"(?:UTF|utf)-8\"|'(?:UTF|utf)-8'))?\s*\?>"
_COMMENT = r"<!--(?:[^\-\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]|-[^\-\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}])*-->"
_VALUE = rf"(?:\"(?:{_CHAR}|{_ENTITY})*\"|'(?:{_CHAR}|{_ENTITY})*')"
_TAG = rf"<(?:/{_NAME}\s*|{_NAME}(?:\s+{_NAME}\s*=\s*{_VALUE})*\s*/?)>"
#: Texts whose lexical form is plain: tags, attributes without raw quotes or angles in them, comments and white space.
_PLAIN = rf"^(?:{_DECLARATION})?(?:\s|{_COMMENT}|{_TAG})*$"
_NUMERIC = re.compile(r"&#(x?)([0-9a-fA-F]+);")


def decoded(values: pa.Array) -> pa.Array:
    """Attribute values with white space normalised and entities resolved."""
    if pc.any(pc.match_substring_regex(values, r"[\t\r\n]"), min_count=1).as_py():
        values = pc.replace_substring_regex(values, r"\r\n|[\t\r\n]", " ")
    coded = pc.fill_null(pc.match_substring(values, "&"), False)
    if not pc.any(coded).as_py():
        return values
    some = values.filter(coded)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        some = pc.replace_substring(some, name, char)
    numeric = pc.match_substring(some, "&#")
    if pc.any(numeric).as_py():
        plain = [_NUMERIC.sub(lambda m: chr(int(m[2], 16 if m[1] else 10)), x) for x in some.filter(numeric).to_pylist()]
        some = pc.replace_with_mask(some, numeric, pa.array(plain, pa.string()))
    return pc.replace_with_mask(values, coded, pc.replace_substring(some, "&amp;", "&"))


@dataclass
class XmlNodes:
    """Elements of one name with wanted attributes (null if absent), and their own tags and references."""

    record: np.ndarray
    attributes: dict[str, pa.Array]
    tag_element: np.ndarray
    tag_keys: pa.Array
    tag_values: pa.Array
    ref_element: np.ndarray
    refs: pa.Array


def _plain_nodes(texts: pa.Array, where: np.ndarray, name: str, wanted: tuple[str, ...]) -> XmlNodes:
    texts = pc.replace_substring_regex(pc.replace_substring_regex(texts, f"^{_DECLARATION}", ""), _COMMENT, "")
    data, offsets = _buffer(texts)
    data = np.where(data == ord("'"), np.uint8(ord('"')), data)
    at = np.arange(len(data))
    blank = _BLANK[data]
    start, end = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    closes = data[start + 1] == ord("/") if len(start) else np.empty(0, bool)
    alone = data[end - 1] == ord("/") if len(end) else np.empty(0, bool)
    opens = ~closes & ~alone
    stops = np.flatnonzero(blank | (data == ord(">")) | (data == ord("/")))
    head = start + 1 + closes
    tail = stops[np.searchsorted(stops, head)] if len(start) else head
    names = slices(data, head, tail).dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(start) else np.empty(0, np.int64)
    word = {v: i for i, v in enumerate(names.dictionary.to_pylist())}
    doc = np.searchsorted(offsets, start, "right") - 1

    bad = np.zeros(len(where), bool)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    base = np.r_[0, depth][np.searchsorted(doc, np.arange(len(where)))]
    bad[doc[depth - base[doc] < 0]] = True
    bad |= np.r_[0, depth][np.searchsorted(doc, np.arange(len(where)), "right")] != base
    keep = ~bad[doc]
    back = np.flatnonzero(keep)
    depth = np.cumsum((opens.astype(np.int64) - closes)[back])
    parent = parents_of(depth - opens[back] + closes[back], opens[back])
    wrong = closes[back] & ((parent < 0) | (code[back] != code[back][np.maximum(parent, 0)]))
    bad[doc[back[wrong]]] = True
    roots = ~closes[back] & (parent < 0)
    bad |= np.bincount(doc[back[roots]], minlength=len(where)) != 1
    full = np.full(len(start), -1)
    full[back] = np.where(parent >= 0, back[np.maximum(parent, 0)], -1)

    quotes = np.flatnonzero(data == ord('"'))
    a, z = quotes[::2], quotes[1::2]
    solid, gap = np.maximum.accumulate(np.where(~blank, at, 0)) if len(at) else at, np.maximum.accumulate(np.where(blank, at, -1)) if len(at) else at
    equals = solid[a - 1] if len(a) else a
    ends = solid[equals - 1] if len(a) else a
    begins = gap[ends] + 1 if len(a) else a
    of = np.searchsorted(start, a, "right") - 1
    labels = slices(data, begins, ends + 1).dictionary_encode()
    label = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(a) else np.empty(0, np.int64)
    known = {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
    both = of * np.int64(len(known) + 1) + label
    order = np.sort(both)
    bad[doc[order[1:][order[1:] == order[:-1]] // (len(known) + 1)]] = True  # an attribute given twice

    good = ~bad[doc] & ~closes
    node = np.flatnonzero(good & (code == word.get(name, -1)))
    number = np.full(len(start) + 1, -1)
    number[node] = np.arange(len(node))

    def attribute(label_name: str, owners: np.ndarray) -> pa.Array:
        hit = label == known.get(label_name, -1)
        at_ = np.full(len(start), -1)
        at_[of[hit]] = np.flatnonzero(hit)
        found = at_[owners]
        have = found >= 0
        values = decoded(slices(data, a[found[have]] + 1, z[found[have]]))
        place = np.full(len(owners), -1)
        place[have] = np.arange(have.sum())
        return taken(values, place)

    tag = np.flatnonzero(good & (code == word.get("tag", -1)) & (number[full] >= 0) & (full >= 0))
    k, v = attribute("k", tag), attribute("v", tag)
    both_there = pc.and_(k.is_valid(), v.is_valid())
    of_node = number[full[tag]][both_there.to_numpy(zero_copy_only=False)]
    order = np.argsort(of_node, kind="stable")
    nd = np.flatnonzero(good & (code == word.get("nd", -1)) & (number[full] >= 0) & (full >= 0))
    ref = attribute("ref", nd)
    has = ref.is_valid()
    of_way = number[full[nd]][has.to_numpy(zero_copy_only=False)]
    line = np.argsort(of_way, kind="stable")
    tags = (of_node[order], k.filter(both_there).take(pa.array(order)), v.filter(both_there).take(pa.array(order)))
    return XmlNodes(where[doc[node]] if len(node) else node, {w: attribute(w, node) for w in wanted}, *tags, of_way[line], ref.filter(has).take(pa.array(line)))


def xml_nodes(texts: pa.Array, name: str = "node", wanted: tuple[str, ...] = ("id",)) -> XmlNodes:
    """Elements of the name at any depth of the well-formed texts, in their order, with wanted attributes and own tags.

    Own tags are direct children called tag that have k and v, references the ref of those called nd. Texts that are not lexically plain (CDATA, processing
    instructions, document types, text between tags, raw quotes inside values, or errors) go through the XML parser one by one.
    """
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    plain = valid & pc.fill_null(pc.match_substring_regex(texts, _PLAIN), False).to_numpy(zero_copy_only=False)
    where = np.flatnonzero(plain)
    out = _plain_nodes(texts.take(pa.array(where)), where, name, wanted)
    rest = np.flatnonzero(valid & ~plain)
    found = [(r, e) for r, x in zip(rest.tolist(), texts.take(pa.array(rest)).to_pylist()) for e in xml_elements(x, name, references=True)]
    if not found:
        return out
    base = len(out.record)
    record = np.concatenate([out.record, [r for r, _ in found]]).astype(np.int64)
    order = np.argsort(record, kind="stable")
    back = np.argsort(order)
    attributes = {w: pa.concat_arrays([c, pa.array([e[0].get(w) for _, e in found], pa.string())]).take(pa.array(order)) for w, c in out.attributes.items()}

    def merged(of: np.ndarray, rows: list[tuple], *columns: pa.Array) -> list:
        element = back[np.concatenate([of, [r[0] for r in rows]]).astype(np.int64)]
        line = np.argsort(element, kind="stable")
        return [element[line], *(pa.concat_arrays([c, pa.array([r[i] for r in rows], pa.string())]).take(pa.array(line)) for i, c in enumerate(columns, 1))]

    tags = merged(out.tag_element, [(base + i, *kv) for i, (_, e) in enumerate(found) for kv in e[1]], out.tag_keys, out.tag_values)
    return XmlNodes(record[order], attributes, *tags, *merged(out.ref_element, [(base + i, ref) for i, (_, e) in enumerate(found) for ref in e[2]], out.refs))


def node_elements(texts: pa.Array) -> Elements:
    """xml_nodes as elements; nodes have no references."""
    x = xml_nodes(texts)
    none = np.empty(0, np.int64)
    return Elements(x.record, whole_numbers(x.attributes["id"]), none, none, pa.array([], pa.string()), x.tag_element, x.tag_keys, x.tag_values)
