"""From XML to columns of elements. Python runs per slice of documents, never per element where a document is plain."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Columns that elements can have, and their Spark types.
COLUMN_TYPES = {
    "doc_id": "string", "node_id": "int", "parent_id": "int", "anc_ids": "array<int>", "last_desc": "int", "depth": "int", "sib_pos": "int",
    "kind": "string", "tag": "string", "attrs": "map<string,string>", "text": "string", "tail": "string", "anc_tags": "array<string>", "top_tag": "string",
}
KINDS = ("element", "comment", "pi", "error")
SLICE = 2 << 20  # bytes of documents that are looked at together
DEEPEST = 64  # documents of deeper trees are read by handlers


@dataclass(frozen=True)
class Path:
    """Places along the way to an element: for it and its ancestors that are one ``of`` (None: all), how many of its siblings up to itself are ``counts``.

    The way begins below the nearest ancestor that is ``below`` (null where there is none), or, without ``below``, at the root.
    """

    counts: tuple[str, ...]
    of: tuple[str, ...] | None = None
    below: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Asked:
    """What leaves the parser.

    ``columns`` of elements with one of ``tags`` (None: of all), with one of the attributes ``attrs``, or whose text isn't ASCII though their tag is not among
    ``ascii_but``; documents that can't be read always. With ``dropped``, comments, processing instructions and elements of these tags are taken out with all that is
    below them, and their tails join what stands before. ``top_tag`` is the nearest ancestor that is one of ``top``.

    More columns by name: ``values`` of attributes, ``top_values`` of attributes of the nearest ancestor that is one of ``top``, ``firsts``: the text of an
    element's first child with a tag, ``under``: whether one of some tags is above, ``within`` and ``holds``: whether an element of a tag has a value for an
    attribute (tag, attribute, value; spaces around it don't count) and is itself or above, or itself or below, and ``paths``.
    """

    columns: tuple[str, ...]
    tags: tuple[str, ...] | None = None
    attrs: tuple[str, ...] = ()
    ascii_but: tuple[str, ...] | None = None
    dropped: tuple[str, ...] | None = None
    top: tuple[str, ...] = ()
    values: tuple[tuple[str, str], ...] = ()
    top_values: tuple[tuple[str, str], ...] = ()
    firsts: tuple[tuple[str, str], ...] = ()
    under: tuple[tuple[str, tuple[str, ...]], ...] = ()
    within: tuple[tuple[str, tuple[str, str, str]], ...] = ()
    holds: tuple[tuple[str, tuple[str, str, str]], ...] = ()
    paths: tuple[tuple[str, Path], ...] = ()

    def schema(self) -> str:
        more = ((self.values, "string"), (self.top_values, "string"), (self.firsts, "string"), (self.under, "boolean"), (self.within, "boolean"), (self.holds, "boolean"), (self.paths, "array<int>"))
        return ", ".join([f"`{c}` {COLUMN_TYPES[c]}" for c in self.columns] + [f"`{name}` {kind}" for columns, kind in more for name, _ in columns])


@dataclass
class Elements:
    """Elements of some documents in document order. ``parent`` is a row (-1: none), ``kind`` a place in KINDS, ``tag`` one in ``names`` (-1: none)."""

    ids: pa.Array
    doc: np.ndarray
    node: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    last: np.ndarray
    kind: np.ndarray
    gone: np.ndarray
    tag: np.ndarray
    names: list[str]
    keys: pa.DictionaryArray
    values: pa.Array
    attrs_at: np.ndarray
    words: pa.Array
    text: np.ndarray  # a place in ``words``; -1: none
    tail: np.ndarray

    def is_one(self, tags: Iterable[str] | None) -> np.ndarray:
        """Which elements have one of these tags."""
        if tags is None:
            return self.kind == 0
        known = np.array([*(n in set(tags) for n in self.names), False])
        return known[self.tag] & (self.kind == 0)

    def siblings(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows with siblings side by side, in order, and where in that each row's siblings begin."""
        order = np.argsort(self.depth.astype(np.uint16) if len(self.depth) and self.depth.max() < 65536 else self.depth, kind="stable")
        family = np.where(self.parent < 0, -1 - self.doc, self.parent)[order]
        first = np.ones(len(order), bool)
        first[1:] = (family[1:] != family[:-1]) | (self.depth[order][1:] != self.depth[order][:-1])
        return order, np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))

    def places(self, order: np.ndarray, start: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """How many siblings up to each element have the flag."""
        seen = np.concatenate([[0], np.cumsum(flag[order])])
        out = np.empty(len(order), np.int32)
        out[order] = seen[1:] - seen[start]
        return out

    def map_of(self, rows: np.ndarray) -> pa.Array:
        """Attributes of rows."""
        begins, size = self.attrs_at[:-1][rows], np.diff(self.attrs_at)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        take = pa.array(np.repeat(begins - at[:-1], size) + np.arange(at[-1]))
        return pa.MapArray.from_arrays(pa.array(at.astype(np.int32)), self.keys.take(take).dictionary_decode(), self.values.take(take))

    def value_of(self, attr: str) -> np.ndarray:
        """Where the value of an attribute is for each element; -1: it has none."""
        out = np.full(len(self.node), -1, np.int64)
        if attr in self.keys.dictionary.to_pylist():
            at = np.flatnonzero(self.keys.indices.to_numpy() == self.keys.dictionary.to_pylist().index(attr))
            out[np.searchsorted(self.attrs_at, at, "right") - 1] = at
        return out

    def has(self, tag: str, attr: str, value: str) -> np.ndarray:
        """Which elements of a tag have a value for an attribute."""
        at = self.value_of(attr)
        there = np.flatnonzero((at >= 0) & self.is_one((tag,)) & ~self.gone)
        out = np.zeros(len(self.node), bool)
        out[there] = pc.equal(pc.utf8_trim(self.values.take(pa.array(at[there])), " "), value).to_numpy(zero_copy_only=False)
        return out

    def first_of(self, tag: str) -> np.ndarray:
        """The first child with a tag for each element; -1: there is none."""
        out = np.full(len(self.node), -1, np.int64)
        child = np.flatnonzero(self.is_one((tag,)) & ~self.gone & (self.parent >= 0))[::-1]
        out[self.parent[child]] = child
        return out


def strings(names: list[str], codes: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes, mask=codes < 0)) if names else pa.nulls(len(codes), pa.string())


def chosen(words: pa.Array, at: np.ndarray) -> pa.Array:
    return words.take(pa.array(at, mask=at < 0)) if len(words) else pa.nulls(len(at), pa.string())


def batch_of(e: Elements, asked: Asked) -> pa.RecordBatch:
    """The rows and columns that are asked for."""
    keep = np.ones(len(e.node), bool)
    if asked.tags is not None:
        keep = e.is_one(asked.tags) | (e.kind == 3)
        for attr in asked.attrs:
            keep |= e.value_of(attr) >= 0
        if asked.ascii_but is not None:
            odd = np.append(_not_ascii(e.words), False)
            keep |= odd[e.text] & ~e.is_one(asked.ascii_but) & (e.kind == 0)
    keep &= ~e.gone
    rows = np.flatnonzero(keep)
    depth = e.depth[rows].astype(np.int64)

    # each row's ancestors from the root down, and itself at the end
    ends = np.cumsum(depth + 1)
    begins = ends - depth - 1
    way = np.empty(ends[-1] if len(ends) else 0, np.int64)
    at, now = ends - 1, rows
    while len(now):
        way[at] = now
        up = e.parent[now]
        on = up >= 0
        at, now = at[on] - 1, up[on]
    own = np.zeros(len(way), bool)
    own[ends - 1] = True

    def above(test: np.ndarray) -> np.ndarray:
        """Where in the way the nearest ancestor is that meets the test; -1: there is none."""
        if not len(way):
            return np.zeros(0, np.int64)
        return np.maximum.reduceat(np.where(test[way] & ~own, np.arange(len(way)), -1), begins)

    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
    out: dict[str, pa.Array] = {}
    order = start = None
    if "sib_pos" in asked.columns or asked.paths:
        order, start = e.siblings()
    if asked.top:
        top = above(e.is_one(asked.top))
        top = np.where(top >= 0, way[top], -1) if len(way) else top
    ints = lambda c, none=None: pa.array(c.astype(np.int32), mask=none)
    for c in asked.columns:
        if c == "doc_id":
            out[c] = e.ids.take(pa.array(e.doc[rows]))
        elif c in ("node_id", "last_desc", "depth"):
            out[c] = ints({"node_id": e.node, "last_desc": e.last, "depth": e.depth}[c][rows])
        elif c == "parent_id":
            p = e.parent[rows]
            out[c] = ints(e.node[p], p < 0)
        elif c == "anc_ids":
            out[c] = lists(depth, ints(e.node[way[~own]]))
        elif c == "anc_tags":
            out[c] = lists(depth, strings(e.names, e.tag[way[~own]]))
        elif c == "sib_pos":
            out[c] = ints(e.places(order, start, np.ones(len(order), bool))[rows] - 1)
        elif c == "kind":
            out[c] = strings(list(KINDS), e.kind[rows])
        elif c == "tag":
            out[c] = strings(e.names, e.tag[rows])
        elif c == "attrs":
            out[c] = e.map_of(rows)
        elif c in ("text", "tail"):
            out[c] = chosen(e.words, (e.text if c == "text" else e.tail)[rows])
        elif c == "top_tag":
            out[c] = strings(e.names, np.where(top >= 0, e.tag[top], -1))
    for name, attr in asked.values:
        out[name] = chosen(e.values, e.value_of(attr)[rows])
    for name, attr in asked.top_values:
        out[name] = chosen(e.values, np.where(top >= 0, e.value_of(attr)[top], -1))
    for name, tag in asked.firsts:
        child = e.first_of(tag)[rows]
        out[name] = chosen(e.words, np.where(child >= 0, e.text[child], -1))
    for name, tags in asked.under:
        out[name] = pa.array(above(e.is_one(tags)) >= 0)
    for name, which in asked.within:
        out[name] = pa.array(e.has(*which)[rows] | (above(e.has(*which)) >= 0))
    for name, which in asked.holds:
        seen = np.concatenate([[0], np.cumsum(e.has(*which))])
        out[name] = pa.array(seen[rows + e.last[rows] - e.node[rows] + 1] > seen[rows])  # what is below follows, with numbers without gaps
    for name, path in asked.paths:
        place = e.places(order, start, e.is_one(path.counts))
        kept, none = e.is_one(path.of)[way], None
        if path.below is not None:
            low = above(e.is_one(path.below))
            none = low < 0
            kept &= np.arange(len(way)) > np.repeat(low, depth + 1)
            kept &= ~np.repeat(none, depth + 1)
        n = np.add.reduceat(kept.astype(np.int64), begins) if len(way) else np.zeros(0, np.int64)
        out[name] = lists(n, ints(place[way[kept]]))
        if none is not None and none.any():
            out[name] = pa.ListArray.from_arrays(out[name].offsets, out[name].values, mask=pa.array(none))
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _not_ascii(words: pa.Array) -> np.ndarray:
    """Which of some strings hold more than ASCII."""
    if not len(words):
        return np.zeros(0, bool)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    high = np.flatnonzero(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] >= 128) + ends[0] if data else np.zeros(0, np.int64)
    return np.searchsorted(high, ends[1:]) > np.searchsorted(high, ends[:-1])


class Handled:
    """Documents read one by one with the parser's handlers, whatever they hold. One that can't be read is a single row of kind ``error``."""

    def __init__(self, dropped: tuple[str, ...] | None = None) -> None:
        self.dropped = dropped
        self.ids, self.doc, self.nodes, self.parents, self.ends, self.depths = [], [], [], [], [], []
        self.kinds, self.tags, self.texts, self.tails, self.gone = [], [], [], [], []
        self.keys, self.values, self.attrs_at = [], [], [0]

    def __len__(self) -> int:
        return len(self.doc)

    def _row(self, node: int, parent: int, depth: int, kind: int, tag: str | None, text: str | None, attrs: list[str]) -> None:
        self.doc.append(len(self.ids) - 1)
        self.nodes.append(node)
        self.parents.append(parent)
        self.ends.append(node)
        self.depths.append(depth)
        self.kinds.append(kind)
        self.tags.append(tag)
        self.texts.append(text)
        self.tails.append(None)
        self.gone.append(False)
        self.keys += attrs[::2]
        self.values += attrs[1::2]
        self.attrs_at.append(len(self.keys))

    def _cut(self, n: int) -> None:
        """Back to the first ``n`` rows."""
        for c in (self.doc, self.nodes, self.parents, self.ends, self.depths, self.kinds, self.tags, self.texts, self.tails, self.gone):
            del c[n:]
        del self.attrs_at[n + 1 :]
        for c in (self.keys, self.values):
            del c[self.attrs_at[-1] :]

    def add(self, doc_id: str | None, xml: str | None) -> None:
        from xml.parsers import expat

        self.ids.append(doc_id)
        base = len(self)
        stack: list[int] = []
        last: list[int | None] = [None]  # the row whose tail comes next; None: the parent's text

        def node(kind: int, tag: str | None, attrs: list[str], text: str | None) -> int:
            self._row(len(self) - base, stack[-1] if stack else -1, len(stack), kind, tag, text, attrs)
            return len(self) - 1

        def start(tag: str, attrs: list[str]) -> None:
            stack.append(node(0, tag, attrs, None))
            last[0] = None

        def end(_: str) -> None:
            i = stack.pop()
            self.ends[i] = len(self) - base - 1
            last[0] = i

        def words(data: str) -> None:
            if stack:
                column, i = (self.texts, stack[-1]) if last[0] is None else (self.tails, last[0])
                column[i] = (column[i] or "") + data

        def leaf(kind: int, tag: str | None, text: str) -> None:
            last[0] = node(kind, tag, [], text)

        p = expat.ParserCreate()
        p.ordered_attributes = p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, words
        p.CommentHandler = lambda data: leaf(1, None, data)
        p.ProcessingInstructionHandler = lambda target, data: leaf(2, target, data)
        try:
            p.Parse(xml or "", True)
        except expat.ExpatError as e:
            self._cut(base)
            self._row(0, -1, 0, 3, None, str(e), [])
        else:
            if self.dropped is not None:
                self._drop(base)

    def _drop(self, base: int) -> None:
        """Marks what goes, and moves tails to the nearest element before that stays, or to the parent's text."""
        until, near = -1, {}
        for i in range(base, len(self)):
            if i <= until:
                self.gone[i] = True
                continue
            p = self.parents[i]
            if not self.kinds[i] and self.tags[i] not in self.dropped:
                near[p] = i
                continue
            self.gone[i], until = True, base + self.ends[i]
            if self.tails[i] is not None:
                column, home = (self.tails, near[p]) if p in near else (self.texts, p)
                column[home] = (column[home] or "") + self.tails[i]

    def elements(self) -> Elements:
        names = list(dict.fromkeys(t for t in self.tags if t is not None))
        code = {t: i for i, t in enumerate(names)}
        spoken = [t for t in (*self.texts, *self.tails) if t is not None]
        there = np.array([t is not None for t in (*self.texts, *self.tails)], bool)
        at = np.where(there, np.cumsum(there) - 1, -1)
        ints = lambda c: np.array(c, np.int64)
        return Elements(
            pa.array(self.ids, pa.string()), ints(self.doc), ints(self.nodes), ints(self.parents), ints(self.depths), ints(self.ends), ints(self.kinds), np.array(self.gone, bool),
            ints([code.get(t, -1) for t in self.tags]), names, pa.array(self.keys, pa.string()).dictionary_encode(), pa.array(self.values, pa.string()), ints(self.attrs_at), pa.array(spoken, pa.string()), at[: len(self)], at[len(self) :],
        )


def _pieces(data: pa.Buffer, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings at these places of a buffer, in order and apart from each other."""
    at = np.empty(2 * len(begins), np.int32)
    at[::2], at[1::2] = begins, ends
    if not len(begins):
        return pa.array([], pa.string())
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data).take(pa.array(np.arange(0, len(at), 2)))


def _sound(xml: bytes) -> bool:
    from xml.parsers import expat

    try:
        expat.ParserCreate("utf-8").Parse(xml, True)
    except expat.ExpatError:
        return False
    return True


def plain_elements(ids: pa.Array, xml: pa.Array, dropped: tuple[str, ...] | None = None) -> Elements | np.ndarray:
    """The elements of documents of plain markup, by the positions of its signs; or which documents are not plain.

    Plain is what the parser takes without complaint and what has no comments, instructions, declarations, references to characters,
    returns, single quotes or breaks inside tags, ``>`` outside of them, or ``dropped`` elements. All else goes by handlers.
    """
    n_docs = len(xml)
    data = xml.buffers()[2]
    offs = np.frombuffer(xml.buffers()[1], np.int32)[xml.offset : xml.offset + n_docs + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[: offs[-1]] if data else np.zeros(0, np.uint8)
    low = offs[0]
    doc_of = lambda at: np.searchsorted(offs, at, "right") - 1
    find = lambda test: np.flatnonzero(test) + low
    rough = np.zeros(n_docs, bool)
    seen = buf[low:]
    lt, gt = find(seen == 60), find(seen == 62)
    rough[doc_of(find((seen == 38) | (seen == 13)))] = True
    n_lt, n_gt = (np.bincount(doc_of(x), minlength=n_docs) for x in (lt, gt))
    rough |= (n_lt != n_gt) | (n_lt == 0)
    if rough.any():
        return rough
    rough[doc_of(lt[lt > gt])] = True
    rough[doc_of(lt[1:][gt[:-1] > lt[1:]])] = True
    rough[doc_of(lt[np.isin(buf[lt + 1], (33, 63))])] = True
    for i in np.flatnonzero(~rough):
        rough[i] = not _sound(bytes(buf[offs[i] : offs[i + 1]]))
    if rough.any():
        return rough

    within = lambda at: (k := np.searchsorted(lt, at, "right") - 1, (k >= 0) & (at < gt[k]))
    closing = buf[lt + 1] == 47
    single = ~closing & (buf[gt - 1] == 47)
    a = find(seen == 39)
    rough[doc_of(a[within(a)[1]])] = True
    q = find(seen == 34)
    tag_of, inside = within(q)
    q, tag_of = q[inside], tag_of[inside]
    odd = np.bincount(tag_of, minlength=len(lt)) % 2 == 1
    if rough.any() or odd.any():
        rough[doc_of(lt[odd])] = True
        return rough
    opened, shut, tag_of = q[::2], q[1::2], tag_of[::2]
    w = find(seen <= 32)
    w_tag, inside = within(w)
    w, w_tag = w[inside], w_tag[inside]
    rough[doc_of(w[buf[w] != 32])] = True
    j = np.searchsorted(opened, w, "right") - 1
    outside = ~((j >= 0) & (w < shut[j])) if len(opened) else np.ones(len(w), bool)
    w, w_tag = w[outside], w_tag[outside]
    has = np.bincount(w_tag, minlength=len(lt))
    attrs = np.bincount(tag_of, minlength=len(lt))
    rough[doc_of(lt[has != attrs])] = True  # a space before each attribute, and none elsewhere
    name_end = gt - single
    first = np.append(w, buf.size)[np.searchsorted(w, lt)]
    name_end = np.where(has > 0, np.minimum(first, name_end), name_end)
    before = np.append(0, shut[:-1] + 1) if len(shut) else shut
    same = np.zeros(len(tag_of), bool)
    same[1:] = tag_of[1:] == tag_of[:-1]
    before = np.where(same, before, name_end[tag_of])
    rough[doc_of(opened[(buf[before] != 32) | (buf[opened - 1] != 61)])] = True
    if rough.any():
        return rough

    is_open = ~closing
    step = np.where(closing, -1, np.where(single, 0, 1))
    level = np.concatenate([[0], np.cumsum(step)[:-1]])
    at_tag = np.flatnonzero(is_open)
    depth = level[at_tag]
    deep = depth >= DEEPEST
    names = _pieces(data, lt[at_tag] + 1, name_end[at_tag]).dictionary_encode()
    known, tag = names.dictionary.to_pylist(), names.indices.to_numpy()
    doc = doc_of(lt[at_tag])
    deep |= np.array([*(t in dropped for t in known), False])[tag] if dropped else False
    if deep.any():
        rough[doc[deep]] = True
        return rough

    n = len(at_tag)
    parent = np.full(n, -1, np.int64)
    order = np.argsort(depth.astype(np.uint8), kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(depth))])
    for d in range(1, len(bounds) - 1):
        over, mine = order[bounds[d - 1] : bounds[d]], order[bounds[d] : bounds[d + 1]]
        parent[mine] = over[np.searchsorted(over, mine) - 1]
    base = np.searchsorted(doc, np.arange(n_docs))
    count = np.cumsum(is_open)
    last, end_tag = np.arange(n), at_tag.copy()
    long = np.flatnonzero(~single[at_tag])
    shuts = np.flatnonzero(closing)
    # the k-th element of a level that is opened is the k-th that is closed there
    mine, theirs = long[np.argsort(depth[long].astype(np.uint8), kind="stable")], shuts[np.argsort((level[shuts] - 1).astype(np.uint8), kind="stable")]
    end_tag[mine] = theirs
    last[mine] = count[theirs] - 1

    # what follows each tag up to the next
    stop = np.append(lt[1:], buf.size)
    words = gt + 1
    filled = stop > words
    pieces = _pieces(data, words, stop)
    text = np.where(filled[at_tag] & ~single[at_tag], at_tag, -1)
    tail = np.where(filled[end_tag] & (depth > 0), end_tag, -1)
    attrs_at = np.concatenate([[0], np.cumsum(attrs[at_tag])])
    # names and values take turns
    bounds = np.empty(2 * len(opened), np.int64)
    bounds[::2], bounds[1::2] = before + 1, opened + 1
    upto = np.empty(2 * len(opened), np.int64)
    upto[::2], upto[1::2] = opened - 1, shut
    both = _pieces(data, bounds, upto)
    return Elements(ids, doc, np.arange(n) - base[doc], parent, depth, last - base[doc], np.zeros(n, np.int64), np.zeros(n, bool), tag, known, both.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode(), both.take(pa.array(np.arange(1, len(both), 2))), attrs_at, pieces, text, tail)


def element_batches(parts: Iterable[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
    """Columns of elements for batches of documents (id, xml): whole documents each, some thousands of rows or more."""
    for part in parts:
        ids, xml = part.column(0).cast(pa.string()), part.column(1).cast(pa.string())
        for i, j in _slices(xml):
            yield from _read(ids.slice(i, j - i), xml.slice(i, j - i), asked)


def _slices(xml: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.frombuffer(xml.buffers()[1], np.int32)[xml.offset : xml.offset + len(xml) + 1].astype(np.int64) if len(xml) else np.zeros(1, np.int64)
    i = 0
    while i < len(xml):
        j = max(int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1, i + 1)
        yield i, j
        i = j


def _read(ids: pa.Array, xml: pa.Array, asked: Asked) -> Iterator[pa.RecordBatch]:
    rough_ids, rough_xml = [], []
    rough = xml.is_null().to_numpy(zero_copy_only=False)
    while True:
        if rough.any():
            mask = pa.array(rough)
            rough_ids += ids.filter(mask).to_pylist()
            rough_xml += xml.filter(mask).to_pylist()
            ids, xml = ids.filter(pa.array(~rough)), xml.filter(pa.array(~rough))
        if not len(xml):
            break
        found = plain_elements(ids, xml, asked.dropped)
        if isinstance(found, Elements):
            yield batch_of(found, asked)
            break
        rough = found
    rows = Handled(asked.dropped)
    for doc_id, text in zip(rough_ids, rough_xml, strict=True):
        rows.add(doc_id, text)
        if len(rows) >= 8192:
            yield batch_of(rows.elements(), asked)
            rows = Handled(asked.dropped)
    if len(rows):
        yield batch_of(rows.elements(), asked)
