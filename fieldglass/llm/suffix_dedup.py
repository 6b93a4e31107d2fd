"""Suffix-array dedup: remove every byte covered by a string of ``span`` bytes that also starts anywhere else.

1. Candidate places. Of the ``gram``-byte grams inside each span-byte window the one with the least hash (the leftmost
   of equals) is the window's anchor. Equal windows have equal anchors at equal offsets, so every repeat lies in
   the context of an anchor whose gram occurs elsewhere: the bytes that windows with that anchor can reach.
2. Occurrences meet by gram. Equal whole contexts at two places are repeats as they stand and need no comparison; a task
   sends two of them at most. Grams with two or more different contexts send one of each on. Grams that are frequent in
   a sample of the texts are dealt by gram and a salt of the context (the sample decides the routing, not the result).
3. Shards of such contexts get a suffix array by Larsson-Sadakane refinement (prefix doubling from eight-byte ranks,
   sorting only groups that aren't settled) and Kasai's common prefixes. A run of suffixes that agree on ``span``
   bytes and start at different places of the corpus is a repeat. A gram with more contexts than a shard takes
   is dealt over several shards. Each of these writes its suffix array once, as the places of its distinct windows in
   suffix order, and each pair of them is merged by binary search of one array's windows in the other's.
4. The intervals found are joined to their texts and cut out.

Spans are judged on the input, so a repeat is removed at all of its places.

Scale: one row an anchor (about one per 70 bytes) is shuffled by gram; texts are shuffled only to cut contexts and to
remove intervals. Sorting by gram streams, so a gram in a third of all documents never sits in memory. Of one gram with
c different contexts, (c / SHARD_CONTEXTS)**2 / 2 pairs of shards are merged: equal contexts cost nothing there, but a
gram with very many different ones does.

Defined cases: null or empty text: no bytes, nothing removed, the digest of no bytes. Texts under ``span`` bytes stay
whole. Rows are told apart by 128 bits of hashes of (doc_id or null, text); repeats of a row are removed like any
copies and returned each. Null doc_ids are ordinary, also many of them. An empty table gives no rows. Extra columns are carried along by ``strip_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import kernels as K
from fieldglass.llm.common import Scratch, arrow, shuffle_width, table

U = np.uint64
GRAM = 64
#: Bytes of contexts that one suffix array takes at most (a single context is never split), and contexts of one gram.
SHARD_BYTES = 2 << 20
SHARD_CONTEXTS = 1024


def window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (van Herk): two running minima over blocks of w."""
    n = len(v)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U)
    pad[:n] = v
    b = pad.reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, span: int, gram: int = GRAM):
    """Of the texts data[offs[r]:offs[r+1]]: for every anchor its row, gram hash, context hash, and the context.

    A context is the bytes of the windows that have the anchor: they start at ``start`` (within the text) and the
    one after; it is ``length`` bytes long. Every window of the texts is in just one context.
    """
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none, none
    h, inv = K.prefix(data)
    g = K.mix((h[gram:] - h[:-gram]) * inv[: len(data) - gram + 1])
    least = window_minimum((g >> U(31) << U(31)) | np.arange(len(g), dtype=U), span - gram + 1)  # of equals the leftmost
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    first = np.flatnonzero(np.arange(len(least)) + span <= offs[row + 1])  # starts of whole windows
    if not len(first):
        return none, none, none, none, none
    at = (least[first] & U(0x7FFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    lo, hi = first[new], first[np.r_[new[1:], len(first)] - 1] + span
    at, r = at[new], row[lo]
    ctx = K.mix((h[hi] - h[lo]) * inv[lo] + (at - lo).astype(U) * U(0x9E3779B97F4A7C15) + (hi - at).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return r, g[at].view(np.int64), ctx.view(np.int64), lo - offs[r], hi - lo


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros past the end."""
    t = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U)
    for j in range(8):
        out = (out << U(8)) | t[j : j + len(text)].astype(U)
    return out


def suffix_order(text: np.ndarray, ends: np.ndarray, span: int, every: bool = False) -> np.ndarray:
    """Starts of span-byte windows (those with start + span <= ends[start]) in suffix order, by Larsson-Sadakane.

    Ranks of eight bytes are refined to 16, 32, ... bytes: a group of equal ranks is sorted by the ranks that many
    bytes on, and groups of one are settled. The last step overlaps, so that a rank is for just ``span`` bytes. Only
    windows that still share their rank are returned (the others occur nowhere else in the text), or ``every`` window.
    """
    place = np.arange(len(text))
    size = 8
    live = place[place + size <= ends]
    key = words8(text)[live]
    order = np.argsort(key)
    rank = np.full(len(text), -1, np.int64)
    live, key = live[order], key[order]
    group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    rank[live] = np.repeat(group, np.diff(np.r_[group, len(live)]))
    alone = np.zeros(len(text), bool)
    single = np.diff(np.r_[group, len(live)]) == 1
    alone[live[group[single]]] = True
    while size < span:
        step = min(size, span - size)
        live = live[~alone[live]]
        live = live[live + size + step <= ends[live]]
        key = (rank[live].astype(U) << U(32)) | rank[live + step].astype(U)
        order = np.argsort(key)
        live, key = live[order], key[order]
        old = key >> U(32)
        group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(live) else np.zeros(0, np.int64)
        start = np.flatnonzero(np.r_[True, old[1:] != old[:-1]]) if len(live) else np.zeros(0, np.int64)
        base = np.repeat(start, np.diff(np.r_[start, len(live)]))
        count = np.diff(np.r_[group, len(live)])
        rank[live] = old.astype(np.int64) + np.repeat(group, count) - base
        alone[live[group[count == 1]]] = True
        size += step
    live = place[place + span <= ends] if every else np.sort(live[~alone[live]])
    return live[np.argsort(rank[live], kind="stable")]  # of equal windows the first place first


def common_prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Kasai's common prefix of each suffix of the order with the one before it (the first: 0).

    Places follow each other in steps of one within each string, a string to a lane: if the place after a suffix's
    predecessor is in the order too, the prefix at the next place is at least that of this one less one, so only what
    goes beyond is compared, eight bytes at a time.
    """
    w = words8(text)
    prev = np.full(len(text), -1, np.int64)
    prev[order[1:]] = order[:-1]
    out = np.zeros(len(text), np.int64)
    have = np.zeros(len(text) + 1, bool)
    have[order] = True
    at, stop, h = starts.copy(), ends[starts], np.zeros(len(starts), np.int64)
    known = np.zeros(len(starts), bool)
    while len(at):
        h = np.where(known, np.maximum(h - 1, 0), 0)
        q = prev[at]
        ok = have[at] & (q >= 0)
        h[~ok] = 0
        lane = np.flatnonzero(ok)
        while len(lane):
            p, r = at[lane], q[lane]
            most = np.minimum(stop[lane] - p, ends[r] - r)
            inside = h[lane] < most
            lane, p, r, most = lane[inside], p[inside], r[inside], most[inside]
            diff = w[p + h[lane]] ^ w[r + h[lane]]
            lead = np.where(diff == 0, 8, (63 - np.floor(np.log2(np.maximum(diff, U(1)).astype(np.float64))).astype(np.int64)) // 8)
            # a float may round a number with a high bit run up by one bit; the byte borders are then off by one
            lead = np.where((diff != 0) & (lead < 8) & (diff >> (U(56) - U(8) * np.minimum(lead, 7).astype(U)) == 0), lead + 1, lead)
            h[lane] = np.minimum(h[lane] + lead, most)
            lane = lane[diff == 0]
        out[at] = h
        known = ok & have[q + 1] & (h != span)  # the order is by span bytes: those that part just after aren't in their order
        at = at + 1
        stay = at < stop
        at, stop, h, known = at[stay], stop[stay], h[stay], known[stay]
    return out[order]


def repeated_windows(strings: list[bytes], span: int) -> np.ndarray:
    """Of the strings joined: which places start a window of ``span`` bytes that starts at another place too."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    stop = np.cumsum(sizes)
    ends = np.repeat(stop, sizes)
    order = suffix_order(text, ends, span)
    hit = np.zeros(len(text), bool)
    if len(order):
        lcp = common_prefixes(text, stop - sizes, ends, order, span)
        same = lcp >= span
        hit[order[same]] = True
        hit[order[:-1][same[1:]]] = True
    return hit


def suffix_array(strings: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeated_windows``, and the first place of each distinct window, in suffix order."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    stop = np.cumsum(sizes)
    ends = np.repeat(stop, sizes)
    order = suffix_order(text, ends, span, every=True)
    same = common_prefixes(text, stop - sizes, ends, order, span) >= span
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[:-1][same[1:]]] = True
    return hit, order[~same]


def _compare(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, span: int) -> np.ndarray:
    """-1, 0 or 1: how the windows at places p (words8 a) stand to those at q (words8 b)."""
    out, lane = np.zeros(len(p), np.int8), np.arange(len(p))
    for off in range(0, span, 8):
        if not len(lane):
            break
        drop = U(8 * max(0, off + 8 - span))
        x, y = a[p[lane] + off] >> drop, b[q[lane] + off] >> drop
        out[lane[x < y]], out[lane[x > y]] = -1, 1
        lane = lane[x == y]
    return out


def merged_windows(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two shards (text, distinct windows in suffix order), which windows of either occur in the other: the windows
    of the shorter array are searched in the longer by bisection."""
    if len(left[1]) > len(right[1]):
        y, x = merged_windows(right, left, span)
        return x, y
    (text, mine), (other, at) = left, right
    a, b = words8(text), words8(other)
    lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(at), np.int64)
    lane = np.flatnonzero(lo < hi)
    while len(lane):
        mid = (lo[lane] + hi[lane]) // 2
        after = _compare(a, mine[lane], b, at[mid], span) > 0
        lo[lane[after]], hi[lane[~after]] = mid[after] + 1, mid[~after]
        lane = lane[lo[lane] < hi[lane]]
    inside = np.flatnonzero(lo < len(at))
    met = inside[_compare(a, mine[inside], b, at[lo[inside]], span) == 0]
    out = np.zeros(len(text), bool), np.zeros(len(other), bool)
    out[0][mine[met]] = True
    out[1][at[lo[met]]] = True
    return out


def _spans(hit: np.ndarray, sizes: np.ndarray, span: int):
    """(string, start, end) of the runs of hit places within each string; a run covers span bytes past its last."""
    base = np.r_[0, np.cumsum(sizes)]
    on = np.flatnonzero(hit)
    if not len(on):
        z = np.zeros(0, np.int64)
        return z, z, z
    s = np.searchsorted(base, on, "right") - 1
    new = np.flatnonzero(np.r_[True, (on[1:] != on[:-1] + 1) | (s[1:] != s[:-1])])
    last = np.r_[new[1:], len(on)] - 1
    return s[new], on[new] - base[s[new]], on[last] - base[s[new]] + span


MARK = "gram long, a long, b long, s long, e long"
#: Contexts that a task remembers having sent; beyond it forgets them and sends more rows than it need.
SEEN = 4_000_000


def _within(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    return (at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] == x) if len(sorted_) else np.zeros(len(x), bool)


class _Collapse:
    """Of each context a task sends the first two at most, so that they meet and are found to be repeats; all others are
    repeats already. ``of`` gives a mask of those to send among the contexts of a chunk in text order."""

    def __init__(self):
        self.once, self.twice = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, ctx: np.ndarray) -> np.ndarray:
        value, first, times = np.unique(ctx, return_index=True, return_counts=True)
        before, often = _within(self.once, value), _within(self.twice, value)
        send = np.zeros(len(ctx), bool)
        send[first[~often]] = True
        again = (times > 1) & ~before  # twice in this chunk: a second one goes along, so that both meet
        second = np.setdiff1d(np.arange(len(ctx)), first, assume_unique=True)
        _, k = np.unique(ctx[second], return_index=True)
        second = second[k]
        send[second[_within(value[again], ctx[second])]] = True
        if len(self.once) > SEEN:
            self.once, self.twice = self.once[:0], self.twice[:0]
        else:
            self.twice = np.sort(np.concatenate([self.twice, value[(before | again) & ~often]]), kind="stable")
            self.once = np.sort(np.concatenate([self.once, value[~before]]), kind="stable")
        return send


def _anchored(span: int, hot: np.ndarray):
    """Rows of contexts: open ones are to meet by (gram, salt); closed ones are intervals of repeats, which pass through."""

    def run(batches):
        import pyarrow as pa

        known = _Collapse()
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, data, offs in K.text_chunks(batch.column(2)):
                r, gram, ctx, start, length = anchors(data, offs, span)
                send = known.of(ctx)
                rows, cs = r[~send], start[~send]
                ce = cs + length[~send]
                # in text order starts and ends both rise, so an interval joins the one before it or begins anew
                new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (cs[1:] > ce[:-1])]) if len(rows) else np.zeros(0, np.int64)
                rows, cs, ce = rows[new], cs[new], ce[np.r_[new[1:], len(rows)] - 1] if len(rows) else ce
                n, at = len(rows), lo + np.r_[rows, r[send]]
                often = _within(hot, gram[send])
                out = [np.r_[np.zeros(n, bool), np.ones(int(send.sum()), bool)], np.r_[np.zeros(n, bool), often]]
                out += [np.r_[K.mix(a[at[:n]].astype(U) + cs.astype(U)).view(np.int64), gram[send]], np.r_[np.zeros(n, np.int32), np.where(often, ctx[send] % SALTS, 0).astype(np.int32)]]
                out += [np.r_[cs * 0, ctx[send]], a[at], b[at], np.r_[cs, start[send]], np.r_[ce, (start + length)[send]]]
                for i in range(0, len(at), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in out], ["open", "hot", "gram", "salt", "ctx", "a", "b", "s", "e"])

    return run


def _met(batches):
    """Over rows sorted by gram and context: gram 0 and the interval of places whose context occurs twice or more;
    gram and interval of one place of each context whose gram has others (or is hot, and so dealt over several tasks).
    Keeps three rows between batches."""
    import pyarrow as pa

    names = ["gram", "a", "b", "s", "e"]
    tail = None  # the last row so far, not yet emitted, with its flags
    state = {"first": None, "many": False}  # the first context's row of the last gram; whether that gram needs no more of it

    def flush(rows, same_gram, same_ctx):
        """rows: those to emit, the next row known; same_*: with the row before, one longer than rows."""
        n, hot = len(rows[0]), rows[6].astype(bool)
        cover = same_ctx[:-1] | same_ctx[1:]
        new_ctx = ~same_ctx[:-1]
        other = new_ctx & same_gram[:-1]  # a context after another of its gram
        first = np.flatnonzero(new_ctx & ~same_gram[:-1])
        gid = np.searchsorted(first, np.arange(n), "right")  # 0: the gram carried from before
        has = np.bincount(gid[other], minlength=len(first) + 1) > 0
        send = other | (new_ctx & hot)
        send[first[has[1:]]] = True
        early = []
        if has[0] and not state["many"] and state["first"] is not None:
            early = [state["first"]]
        if len(first):
            state["first"] = tuple(c[first[-1]] for c in rows)
            state["many"] = bool(has[-1]) or bool(hot[first[-1]])
        else:
            state["many"] = state["many"] or bool(has[0])
        out = [np.concatenate([np.zeros(int(cover.sum()), np.int64), rows[0][send], np.array([e[0] for e in early], np.int64)])]
        for c in range(2, 6):
            out.append(np.concatenate([rows[c][cover], rows[c][send], np.array([e[c] for e in early], np.int64)]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    before = None
    for b in batches:
        open_ = b.column(0).to_numpy(zero_copy_only=False)
        cols = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4, 5, 6, 7, 8, 1)]
        if not open_.all():
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int((~open_).sum()), np.int64)), *(pa.array(c[~open_]) for c in cols[2:6])], names)
            cols = [c[open_] for c in cols]
            if not len(cols[0]):
                continue
        if tail is not None:
            cols = [np.concatenate([[t], c]).astype(np.int64) for t, c in zip(tail, cols, strict=True)]
        tail = [c[-1] for c in cols]
        if len(cols[0]) == 1:
            continue
        g, c = cols[0], cols[1]
        pg, pc = (before if before is not None else (g[0] + 1, c[0]))
        same_gram = np.r_[g[0] == pg if before is not None else False, g[1:] == g[:-1]]
        same_ctx = same_gram & np.r_[c[0] == pc, c[1:] == c[:-1]]
        before = (g[-2], c[-2])
        yield flush([x[:-1] for x in cols], same_gram, same_ctx)
    if tail is not None:
        g, c = tail[0], tail[1]
        sg = before is not None and g == before[0]
        sc = sg and c == before[1]
        yield flush([np.array([t], np.int64) for t in tail], np.array([sg, False]), np.array([sc, False]))


def _contexts(batches):
    import pyarrow as pa

    kinds = [("gram", pa.int64()), ("own", pa.int32()), ("k", pa.int32())]
    for batch in batches:
        for i in range(batch.num_rows):
            a, b, text, wanted = (batch.column(k)[i].as_py() for k in range(4))
            raw = text.encode()
            yield pa.RecordBatch.from_arrays(
                [pa.array([w[c] for w in wanted], t) for c, t in kinds]
                + [pa.array([x] * len(wanted), pa.int64()) for x in (a, b)]
                + [pa.array([w["s"] for w in wanted], pa.int64()), pa.array([raw[w["s"] : w["e"]] for w in wanted], pa.binary())],
                [c for c, _ in kinds] + ["a", "b", "s", "bytes"],
            )


#: What a shard's task returns: intervals, and for a gram over several shards the shard's suffix array.
SHARD = "a long, b long, s long, e long, gram long, own int, k int, text binary, sizes binary, windows binary, pa binary, pb binary, ps binary"


def _emit(found, packed=()):
    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * 6
    rows = [(*f, *[None] * 9) for f in found] + [(*[None] * 4, *p) for p in packed]
    cols = list(zip(*rows, strict=True)) or [()] * 13
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in SHARD.split(", ")])


def _found(a, b, s, sizes, hit: np.ndarray, span: int) -> list[tuple]:
    which, lo, hi = _spans(hit, sizes, span)
    return list(zip(a[which].tolist(), b[which].tolist(), (s[which] + lo).tolist(), (s[which] + hi).tolist(), strict=True))


def _sharded(span: int):
    """Over contexts sorted by (gram, own): whole grams are joined to suffix arrays of SHARD_BYTES; a part of a gram has one
    of its own, which is returned with those of its contexts that hold the first place of some window."""

    def columns(rows):
        return [np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5)] + [np.array([len(r[6]) for r in rows], np.int64)]

    def solve(rows):
        a, b, s, sizes = columns(rows)
        return _found(a, b, s, sizes, repeated_windows([r[6] for r in rows], span), span)

    def part(rows):
        a, b, s, sizes = columns(rows)
        strings = [r[6] for r in rows]
        hit, windows = suffix_array(strings, span)
        base = np.r_[0, np.cumsum(sizes)]
        of = np.searchsorted(base, windows, "right") - 1
        kept = np.unique(of)
        moved = np.zeros(len(rows) + 1, np.int64)
        moved[kept] = np.r_[0, np.cumsum(sizes[kept])[:-1]]
        places = (windows - base[of] + moved[of]).astype(np.int32)
        pack = (rows[0][0], rows[0][1], rows[0][2], b"".join(strings[i] for i in kept), sizes[kept].tobytes(), places.tobytes(), *(x[kept].tobytes() for x in (a, b, s)))
        return _found(a, b, s, sizes, hit, span), pack

    def run(batches):
        held, size, group, key = [], 0, [], None

        def close(group, key):
            nonlocal held, size
            if key[2] > 1:
                out, pack = part(group)
                return out, [pack]
            out = []
            more = sum(len(r[6]) for r in group)
            if held and size + more > SHARD_BYTES:
                out, held, size = solve(held), [], 0
            held += group
            size += more
            return out, []

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if row[:3] != key:
                    if group:
                        out, packed = close(group, key)
                        if out or packed:
                            yield _emit(out, packed)
                    group, key = [], row[:3]
                group.append(row)
        if group:
            yield _emit(*close(group, key))
        if held:
            yield _emit(solve(held))

    return run


def _merged(span: int):
    """Over shards' suffix arrays sorted by (gram, i, j), two to each pair: the intervals of windows that both hold."""

    def side(row):
        sizes, at = np.frombuffer(row[4], np.int64), np.frombuffer(row[5], np.int32).astype(np.int64)
        return (np.frombuffer(row[3], np.uint8), at), [np.frombuffer(x, np.int64) for x in row[6:9]], sizes

    def run(batches):
        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if last is None or last[:3] != row[:3]:
                    last = row
                    continue
                (x, kx, nx), (y, ky, ny) = side(last), side(row)
                hx, hy = merged_windows(x, y, span)
                yield _emit(_found(*kx, nx, hx, span) + _found(*ky, ny, hy, span)).select(["a", "b", "s", "e"])
                last = None

    return run


def _identified(docs: DataFrame) -> DataFrame:
    """The columns of docs with ``__fg_a`` and ``__fg_b``, 128 bits that tell rows apart, and ``__fg_text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("*", F.xxhash64(F.lit(1), *doc, text).alias("__fg_a"), F.xxhash64(F.lit(2), text, *doc).alias("__fg_b"), text.alias("__fg_text"))


#: Tasks that a frequent gram is dealt over, and the share of the texts that is looked at to find frequent grams.
SALTS = 64
LOOK = 0.01
#: Times that a gram of the sample must occur to count as frequent.
OFTEN = 16


def frequent_grams(src: DataFrame, span: int, tasks: int) -> np.ndarray:
    """The 4 * tasks most frequent grams of a sample of the texts, those met OFTEN times or more, sorted. They are only routed otherwise."""

    def grams(batches):
        import pyarrow as pa

        for b in batches:
            for _, data, offs in K.text_chunks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offs, span)[1])], ["gram"])

    some = src.where(F.pmod("__fg_a", F.lit(1_000_003)) < int(LOOK * 1_000_003)).select("__fg_text")
    counts = some.transform(arrow, grams, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(np.array([r.gram for r in counts.orderBy(F.col("n").desc()).limit(4 * tasks).collect()], np.int64))


def repeated_intervals(docs: DataFrame, span: int = 200) -> DataFrame:
    """(__fg_a, __fg_b, spans): the byte intervals of each text with repeats, as an array of (s, e), not yet merged."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    n = shuffle_width(spark)
    src = _identified(docs).select("__fg_a", "__fg_b", "__fg_text")
    hot = frequent_grams(src, span, n)
    placed = src.transform(arrow, _anchored(span, hot), "open boolean, hot boolean, gram long, salt int, ctx long, a long, b long, s long, e long")
    marks = scratch.put(placed.repartition(n, "gram", "salt").sortWithinPartitions("open", "gram", "ctx").transform(arrow, _met, MARK), "marks")
    asked = marks.where("gram <> 0")
    # both sides of the join are tables, so Spark sees their sizes and can split a hot gram's partition
    parts = scratch.put(asked.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_CONTEXTS)).cast("int").alias("k")).where("k > 1"), "parts")
    k = F.coalesce("k", F.lit(1))
    asked = asked.join(parts, "gram", "left").select("a", "b", F.struct("gram", F.pmod(F.xxhash64("a", "b", "s"), k).cast("int").alias("own"), k.alias("k"), "s", "e").alias("w"))
    asked = scratch.put(asked.select(F.col("a").alias("__fg_a"), F.col("b").alias("__fg_b"), "w"), "asked")
    per_text = asked.groupBy("__fg_a", "__fg_b").agg(F.collect_list("w").alias("wanted"))  # as many as the text has places
    one = src.join(per_text, ["__fg_a", "__fg_b"]).dropDuplicates(["__fg_a", "__fg_b"])
    contexts = one.select("__fg_a", "__fg_b", "__fg_text", "wanted").transform(arrow, _contexts, "gram long, own int, k int, a long, b long, s long, bytes binary")
    shards = contexts.repartition(n, "gram", "own").sortWithinPartitions("gram", "own")
    found = scratch.put(shards.transform(arrow, _sharded(span), SHARD), "found")
    split = found.where("gram is not null").drop("a", "b", "s", "e")
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda o: o != F.col("own"))
    pairs = split.withColumn("o", F.explode(others)).select("gram", F.least("o", "own").alias("i"), F.greatest("o", "own").alias("j"), "text", "sizes", "windows", "pa", "pb", "ps")
    pairs = pairs.repartition(n, "gram", "i", "j").sortWithinPartitions("gram", "i", "j").transform(arrow, _merged(span), "a long, b long, s long, e long")
    every = marks.where("gram = 0").select("a", "b", "s", "e").unionByName(found.where("gram is null").select("a", "b", "s", "e")).unionByName(pairs)
    return every.groupBy(F.col("a").alias("__fg_a"), F.col("b").alias("__fg_b")).agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merge(spans) -> list[tuple[int, int]]:
    """Maximal runs of a text's intervals."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in runs:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def _digest(batches):
    import pyarrow as pa

    for b in batches:
        ids, texts, spans = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        out = []
        for text, s in zip(texts, spans, strict=True):
            raw, runs = text.encode(), merge(s)
            out.append((len(raw), sum(e - a for a, e in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _stripped(batches):
    import pyarrow as pa

    for b in batches:
        out = [kept_bytes(t.encode(), merge(s)).decode("utf-8", "ignore") if s else t for t, s in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), pa.array(out, pa.string())], [*b.schema.names[:-2], "__fg_kept"])


def with_intervals(docs: DataFrame, span: int = 200) -> DataFrame:
    """docs with ``__fg_text`` (null: empty) and ``__fg_spans`` (null: none)."""
    got = repeated_intervals(docs, span).withColumnRenamed("spans", "__fg_spans")
    return _identified(docs).join(got, ["__fg_a", "__fg_b"], "left").select(*[F.col(c) for c in docs.columns], "__fg_text", "__fg_spans")


def repeat_digests(docs: DataFrame, span: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_intervals(docs.select("doc_id", "text"), span).select("doc_id", "__fg_text", "__fg_spans")
    return rows.transform(arrow, _digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """docs with the repeats cut out of ``text``; a character that a cut splits goes too. Null texts stay null."""
    rest = [c for c in docs.columns if c != "text"]
    rows = with_intervals(docs, span).select(*rest, F.col("text").isNull().alias("__fg_null"), "__fg_text", "__fg_spans")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + ["__fg_null boolean, __fg_kept string"])
    got = rows.transform(arrow, _stripped, schema)
    return got.select(*[F.when(~F.col("__fg_null"), F.col("__fg_kept")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))
