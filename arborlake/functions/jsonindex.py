"""Vectorised structural index of many JSON texts at once.

All texts of an Arrow batch lie in one byte buffer. Bitmaps of quotes, backslashes, brackets and delimiters and
prefix sums over them give strings, nesting depth and bracket pairs for the whole batch without a loop over
characters; one sort then gives every token its container. A text that is no valid JSON has no content.
"""

from __future__ import annotations

import json
import re

import numpy as np

_NUMBER = re.compile(rb"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\Z")
_WORDS = (b"true", b"false", b"null")
OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR = range(8)
_KINDS = np.full(256, -1, np.int8)
for _c, _k in zip(b"{}[]:,", range(6)):
    _KINDS[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True


def _last(mask: np.ndarray, before: bool) -> np.ndarray:
    """Index of the last True up to each place (before: up to the place before), -1 where there is none."""
    at = np.where(mask, np.arange(len(mask)), -1)
    at = np.maximum.accumulate(at) if len(at) else at
    return np.concatenate([[-1], at[:-1]]) if before and len(at) else at


class Index:
    """Tokens of valid texts: kind, start, end, doc, parent token (-1 at the root), key token, place in the array."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.buf = buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        begin = np.cumsum(sizes) - sizes
        n = len(buf)
        place = np.arange(n)
        doc_of = np.repeat(np.arange(len(texts)), sizes)
        back = buf == 92
        escaped = ((place - 1 - _last(~back, True)) & 1).astype(bool)
        quote = (buf == 34) & ~escaped
        count = np.cumsum(quote)
        base = (count - quote)[begin] if len(begin) else count[:0]
        parity = count - base[doc_of]
        opening, closing = quote & (parity & 1 == 1), quote & (parity & 1 == 0)
        inside = (parity & 1 == 1) | closing
        kind = np.where(inside, -1, _KINDS[buf])
        plain = ~inside & (kind < 0) & ~_SPACE[buf]
        first = plain & ~np.concatenate([[False], plain[:-1]])
        end_plain = plain & ~np.concatenate([plain[1:], [False]])
        bad = np.zeros(len(texts), bool)
        in_string = inside & ~quote
        bad[doc_of[in_string & (buf < 32)]] = True
        bad[doc_of[in_string & escaped & ~_ESCAPABLE[buf]]] = True
        # Tokens in the order of the text.
        tok = np.flatnonzero((kind >= 0) | opening | first)
        kinds = np.where(opening[tok], STRING, np.where(first[tok], SCALAR, kind[tok])).astype(np.int8)
        end = tok + 1
        s, close = kinds == STRING, np.flatnonzero(closing)
        at = np.searchsorted(close, tok[s])
        end[s] = np.where(at < len(close), close[np.minimum(at, len(close) - 1)] + 1, n) if len(close) else n
        last_plain = np.flatnonzero(end_plain)
        end[kinds == SCALAR] = last_plain[np.searchsorted(last_plain, tok[kinds == SCALAR])] + 1
        doc = doc_of[tok]
        odd = np.bincount(doc_of[quote], minlength=len(texts)) & 1
        bad |= odd.astype(bool)
        opens, closes = (kinds == OPEN_OBJ) | (kinds == OPEN_ARR), (kinds == CLOSE_OBJ) | (kinds == CLOSE_ARR)
        step = opens.astype(np.int64) - closes
        run = np.cumsum(step)
        number = np.bincount(doc, minlength=len(texts))
        head = np.cumsum(number) - number
        has = number > 0
        bad |= ~has
        floor = np.zeros(len(texts), np.int64)
        floor[has] = (run - step)[head[has]]
        depth = run - floor[doc]
        low = np.zeros(len(texts), np.int64)
        if len(tok):
            np.minimum.at(low, doc, depth)
            tail = np.zeros(len(texts), np.int64)
            tail[has] = depth[(head + number - 1)[has]]
            bad |= (low < 0) | (tail != 0)
        # Containers: an opener stands at the level within it, everything else at the level around it.
        level = np.where(opens, depth, depth + closes)
        order = np.lexsort((np.arange(len(tok)), level, doc))
        is_open = opens[order]
        inner = _last(is_open, False)
        same = (inner >= 0) & (doc[order[inner]] == doc[order]) & (level[order[inner]] == level[order])
        parent = np.full(len(tok), -1)
        parent[order] = np.where(same, order[inner], -1)
        match = np.full(len(tok), -1)
        c = np.flatnonzero(closes)
        ok = parent[c] >= 0
        match[parent[c[ok]]] = c[ok]
        bad[doc[c[~ok]]] = True
        bad[doc[c[ok][kinds[c[ok]] != kinds[parent[c[ok]]] + 1]]] = True
        # An opener's own container is that of the level around it.
        up_level = np.where(opens, depth - 1, -1)
        o = np.flatnonzero(opens)
        if len(o):
            both = np.concatenate([o, o])
            lev = np.concatenate([depth[o], up_level[o]])
            as_child = np.concatenate([np.zeros(len(o), bool), np.ones(len(o), bool)])
            turn = np.lexsort((both, lev, doc[both]))
            held = _last(~as_child[turn], False)
            fits = (held >= 0) & (doc[both[turn[held]]] == doc[both[turn]]) & (lev[turn[held]] == lev[turn])
            own = np.where(fits, both[turn[held]], -1)
            parent[both[turn][as_child[turn]]] = own[as_child[turn]]
        # Grammar: what may stand before each token in its container.
        prev = np.concatenate([[-1], kinds[:-1]]) if len(tok) else kinds
        if len(tok):
            prev = np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), -1, prev)
        within = np.where(parent >= 0, kinds[parent], -1)
        is_value = opens | (kinds == STRING) | (kinds == SCALAR)
        starts_item = (prev == COMMA) | (prev == within)
        key = (kinds == STRING) & (within == OPEN_OBJ) & starts_item
        prev_key = np.concatenate([[False], key[:-1]]) if len(tok) else key
        ends = (prev == STRING) | (prev == SCALAR) | (prev == CLOSE_OBJ) | (prev == CLOSE_ARR)
        good = np.where(is_value, np.select([within == OPEN_ARR, within == OPEN_OBJ], [starts_item, key | (prev == COLON)], prev == -1),
                        np.select([kinds == COLON, kinds == COMMA], [prev_key, ends & ~prev_key & (within >= 0)],
                                  (ends & ~prev_key) | (prev == kinds - 1)))
        bad[doc[~good]] = True
        scal = np.flatnonzero(kinds == SCALAR)
        raw = buf.tobytes()
        self.raw = raw
        checked: dict[bytes, bool] = {}
        for i in scal:
            w = raw[tok[i] : end[i]]
            if w not in checked:
                checked[w] = w in _WORDS or bool(_NUMBER.match(w))
            if not checked[w]:
                bad[doc[i]] = True
        # The place in an array is the number of commas before it in the same container.
        comma = (kinds == COMMA).astype(np.int64)
        by = np.lexsort((np.arange(len(tok)), parent))
        total = np.cumsum(comma[by])
        fresh = np.concatenate([[True], parent[by][1:] != parent[by][:-1]]) if len(tok) else comma.astype(bool)
        zero = (total - comma[by])[np.maximum.accumulate(np.where(fresh, np.arange(len(tok)), 0))] if len(tok) else total
        nth = np.zeros(len(tok), np.int64)
        nth[by] = total - zero
        self.kind, self.start, self.end, self.doc, self.parent, self.nth, self.valid = kinds, tok, end, doc, parent, nth, ~bad
        self.value = is_value & ~key
        self.live = self.valid[doc]

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def roots(self) -> np.ndarray:
        return np.flatnonzero(self.value & (self.parent < 0) & self.live)

    def children(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value tokens directly within the containers, and for each the position in `of`."""
        where = np.full(len(self.kind), -1)
        where[of] = np.arange(len(of))
        kids = np.flatnonzero(self.value & (self.parent >= 0))
        owner = where[self.parent[kids]]
        return kids[owner >= 0], owner[owner >= 0]

    def fields(self, of: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Value tokens of the field of exactly that name; of a repeated field the last."""
        kids, owner = self.children(of)
        want = np.frombuffer(json.dumps(name).encode(), np.uint8)
        k = kids - 2  # key, colon, value
        hit = (self.end[k] - self.start[k] == len(want)) & (self.kind[k] == STRING)
        kids, owner, k = kids[hit], owner[hit], k[hit]
        hit = (self.buf[self.start[k][:, None] + np.arange(len(want))] == want).all(1) if len(k) else hit[:0]
        kids, owner = kids[hit], owner[hit]
        last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else owner.astype(bool)
        return kids[last], owner[last]


def _plain(raw: bytes) -> str:
    return json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")


def unwrap(text: str | None) -> bytes | None:
    """Bytes of the JSON text, without the codings as a string that lie around it; None for no content."""
    for _ in range(64):
        if text is None:
            return None
        s = text.lstrip()
        if not s.startswith('"'):
            return s.encode("utf-8", "replace")
        try:
            text = json.loads(s)
        except ValueError:
            return None
    return None


def spelling(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def items(texts: list[str | None], steps: list[tuple]) -> list[tuple[int, tuple[int, ...], str]]:
    """(text number, positions, item) for the steps ('key', name), ('each',) and at the end ('item', spellings).

    `each` takes the elements of an array with their positions from 0; anything else that is there counts as an
    array of one. A string that is JSON text of an object or array counts as that. An item is a string or number
    itself, or that field of an object; null, blank and absent give none.
    """
    known = [(i, b) for i, t in enumerate(texts) if (b := unwrap(t)) is not None]
    if not known:
        return []
    number = np.array([i for i, _ in known])
    ix = Index([b for _, b in known])
    out: list[tuple[int, tuple[int, ...], str]] = []
    now = ix.roots()
    src = number[ix.doc[now]]
    pos = np.zeros((len(now), 0), np.int64)
    for at, step in enumerate(steps):
        # Strings that hold JSON go through their own index with the steps that are left.
        strings = np.flatnonzero(ix.kind[now] == STRING)
        coded = [j for j in strings if ix.text(now[j])[1:].lstrip(b" \\ntr")[:1] in (b"[", b"{", b'"')]
        if coded:
            inner = items([_plain(ix.text(now[j])) for j in coded], steps[at:])
            out += [(int(src[coded[i]]), (*map(int, pos[coded[i]]), *p), v) for i, p, v in inner]
            keep = np.ones(len(now), bool)
            valid = Index([b if (b := unwrap(_plain(ix.text(now[j])))) is not None else b"" for j in coded]).valid
            keep[np.array(coded)[valid]] = False
            now, src, pos = now[keep], src[keep], pos[keep]
        if step[0] == "key":
            obj = ix.kind[now] == OPEN_OBJ
            kids, owner = ix.fields(now[obj], step[1])
            now, src, pos = kids, src[obj][owner], pos[obj][owner]
        elif step[0] == "each":
            arr = ix.kind[now] == OPEN_ARR
            kids, owner = ix.children(now[arr])
            single = now[~arr]
            place = np.concatenate([ix.nth[kids], np.zeros(len(single), np.int64)])
            src, pos = np.concatenate([src[arr][owner], src[~arr]]), np.concatenate([pos[arr][owner], pos[~arr]])
            now, pos = np.concatenate([kids, single]), np.column_stack([pos, place])
        else:
            obj = ix.kind[now] == OPEN_OBJ
            kids, owner = ix.children(now[obj])
            found = {}
            for kid, o in zip(kids, owner):
                if spelling(_plain(ix.text(kid - 2))) in step[1] and (v := _value(ix, kid)) is not None:
                    found.setdefault(o, v)
            where = np.flatnonzero(obj)
            out += [(int(src[where[o]]), tuple(map(int, pos[where[o]])), v) for o, v in found.items()]
            out += [(int(src[j]), tuple(map(int, pos[j])), v) for j in np.flatnonzero(~obj) if (v := _value(ix, now[j])) is not None]
    return out


def _value(ix: Index, i: int) -> str | None:
    if ix.kind[i] == STRING:
        s = _plain(ix.text(i))
        return s if s.strip() else None
    if ix.kind[i] == SCALAR and (w := ix.text(i)) not in _WORDS:
        return w.decode()
    return None


def linked(texts: list[str | None]) -> list[tuple[int, str, str | None, str, int, dict[str, str | None]]]:
    """(text number, row, parent row, path, position, values) of every object and of every plain element of an array.

    row is the place of the object or element within its text, as in `a[0].b`, and parent row that of the object or
    element around it (None at the root); path is the same without positions, so that rows of one path have one
    shape. position is that in the nearest array, 0 outside of one. values holds the plain fields of an object as text
    (null as None, true and numbers as written), or the element itself under `value`. Of a repeated field the last
    counts. A string that is JSON text of an object or array counts as that.
    """
    known = [(i, b) for i, t in enumerate(texts) if (b := unwrap(t)) is not None]
    if not known:
        return []
    ix = Index([b for _, b in known])
    kind, parent, nth = ix.kind.tolist(), ix.parent.tolist(), ix.nth.tolist()
    tokens = np.flatnonzero(ix.value & ix.live).tolist()
    names = {i: _plain(ix.text(i - 2)) for i in tokens if parent[i] >= 0 and kind[parent[i]] == OPEN_OBJ}
    last = {(parent[i], n): i for i, n in names.items()}
    out: list[tuple] = []
    # Of each container: its place, its path, the row that its content belongs to, its position and whether it is in an array.
    at: dict[int, tuple[str, str, str | None, int, bool]] = {}
    values: dict[int, dict[str, str | None]] = {}
    for i in tokens:
        p = parent[i]
        if p < 0:
            place, path, up, pos, listed = "", "", None, 0, False
        elif p not in at or (i in names and last[p, names[i]] != i):
            continue
        else:
            place, path, up, pos, listed = at[p]
            if i in names:
                joint = "." if place else ""
                place, path, listed = f"{place}{joint}{names[i]}", f"{path}.{names[i]}" if path else names[i], False
            else:
                place, path, pos = f"{place}[{nth[i]}]", path + "[]" if listed else path, nth[i]
        text = int(known[ix.doc[i]][0])
        if kind[i] == OPEN_OBJ:
            values[i] = {}
            out.append((text, place, up, path, pos if i not in names else 0, values[i]))
            at[i] = (place, path, place, pos, False)
        elif kind[i] == OPEN_ARR:
            at[i] = (place, path, up, pos, p >= 0 and kind[p] == OPEN_ARR)
        else:
            raw = ix.text(i)
            v = (_plain(raw) if kind[i] == STRING else None if raw == b"null" else raw.decode())
            if kind[i] == STRING and v.lstrip()[:1] in ("[", "{", '"') and (inner := linked([v])):
                for _, row, above, sub, spot, own in inner:
                    joint = lambda a, b: f"{a}.{b}" if a and b and not b.startswith("[") else a + b
                    out.append((text, joint(place, row), up if above is None else joint(place, above), joint(path, sub), spot if row else (0 if i in names else pos), own))
            elif i in names:
                values[p][names[i]] = v
            elif p >= 0:
                out.append((text, place, up, path, pos, {"value": v}))
    return out
