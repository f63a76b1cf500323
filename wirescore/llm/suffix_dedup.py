"""Repeated byte strings by suffix arrays.

A byte goes if it is covered by a string of `width` bytes that also starts anywhere else.

1. Anchors. Every string of `width` bytes holds a run of 64 bytes whose hash is the lowest of
   its window (the first of ties); equal strings choose it at the same place. A document's anchors
   are these runs. The strings that choose an anchor start side by side, and together they are its
   window: every string lies in one window, and equal strings stand at the same distance from
   the anchors of theirs. Anchor hashes that occur once in the whole corpus are dropped; the counts
   are partially aggregated sums.
2. Windows. Windows that are equal byte for byte (a 128-bit digest) are one window from here on,
   so copies, however many, cost one; where it stands twice, all of it is repeated.
3. Pieces. Different windows that share an anchor hash meet in one task, which cuts them into runs
   of 16 start offsets. Strings of a run share the bytes in its middle, so runs without a partner
   of the same middle hold no repeated string, and equal runs are one piece, repeated as a whole.
   An anchor with more than `crowd` different windows (a common line in ever new surroundings) is
   dealt out by these middles beforehand.
4. Shards. Pieces that share a middle but differ are searched. Each shard of at most
   `shard_bytes` is a suffix array, refined after Larsson and Sadakane from ranks of 7 bytes by
   doubling within unsorted groups, with common prefixes after Kasai. Neighbours that share
   `width` bytes and start at different places are repeated. When the pieces of one middle fill
   more than one shard, the shards are merged across: the suffixes of each are looked up in
   the others' arrays by binary search.
5. Spans of a document are united, and the bytes that remain are digested.

Edge cases. Null counts as empty. Strings are judged on the input. Rows with the same doc_id and
text are separate documents, so they remove each other. Texts shorter than `width` lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices
from .decontaminate import _BASE, _INVERSE, _powers, mix

RUN = 64
STEP = 16


# ---- anchors


def sliding_minimum(values: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each run of so many values, by block-wise running minima."""
    n = len(values) - window + 1
    padded = np.full(-(-len(values) // window) * window, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[window - 1 : window - 1 + n])


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, position, hash, first start, last start) of every anchor of some texts: the strings
    of `width` bytes that choose it start between the two."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.r_[0, np.cumsum(sizes)]
    none = np.empty(0, np.int64)
    if len(raw) < width:
        return none, none, none.view(np.uint64), none, none
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)]
        hashes = mix((sums[RUN:] - sums[:-RUN]) * _powers(_INVERSE, len(raw))[: len(raw) - RUN + 1])
    window = width - RUN + 1
    low = sliding_minimum(hashes, window)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # A start counts if its width bytes lie in one text.
    starts = np.flatnonzero(np.arange(len(low)) + width <= begins[owner[: len(low)] + 1])
    if not len(starts):
        return none, none, none.view(np.uint64), none, none
    new = np.r_[True, (low[starts[1:]] != low[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)]
    # Within a run of starts with the same minimum, equal hashes may lie further on.
    run_first, run_last = starts[new], starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    reach = run_last + window - run_first
    run = np.repeat(np.arange(len(reach)), reach)
    inside = np.repeat(run_first - np.r_[0, np.cumsum(reach)[:-1]], reach) + np.arange(reach.sum())
    tie = hashes[inside] == low[run_first][run]
    run, at = run[tie], inside[tie]
    # Of ties, the first that is not before the start is chosen.
    later = np.r_[False, run[1:] == run[:-1]]
    first = np.where(later, np.r_[0, at[:-1]] + 1, run_first[run])
    last = np.minimum(at, run_last[run])
    used = first <= last
    at, first, last = at[used], first[used], last[used]
    text = owner[at]
    return text, at - begins[text], hashes[at], first - begins[text], last - begins[text]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    for batch in batches:
        ids, texts = batch.column("rid").to_pylist(), [t or b"" for t in batch.column("t").to_pylist()]
        for a, b in slices([len(t) for t in texts], 1 << 20):
            yield ids[a:b], texts[a:b]


_PLACE = "rid bigint, first int, size int, lead int, h bigint, w1 bigint, w2 bigint"


def _anchor_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for ids, texts in _batches(batches):
        owner, pos, h, first, last = anchors(texts, width)
        lead = pos - first
        windows = [xxh3_128_digest(texts[o][a : b + width], d) for o, a, b, d in zip(owner.tolist(), first.tolist(), last.tolist(), lead.tolist())]
        digest = np.frombuffer(b"".join(windows), "<i8").reshape(-1, 2)
        rid = np.array(ids, np.int64)[owner] if len(owner) else np.empty(0, np.int64)
        small = [pa.array(x.astype(np.int32)) for x in (first, last + width - first, lead)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid), *small, pa.array(h.view(np.int64)), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1]))],
            names=[c.split()[0] for c in _PLACE.split(", ")],
        )


# ---- suffix arrays


def suffix_array(codes: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Suffixes of all windows in order. stop has the place of each code's separator (code 0);
    separators count as different, in the order of their places, so the order is total. Ranks
    of 7 codes are refined by doubling, and only within groups that are not yet single."""
    n = len(codes)
    key = np.zeros(n, np.uint64)
    padded = np.r_[codes.astype(np.uint64), np.zeros(8, np.uint64)]
    at = np.arange(n)
    for i in range(7):  # codes take 9 bits
        key = (key << np.uint64(9)) | np.where(at + i < stop, padded[i : i + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    first[: int((codes == 0).sum())] = True
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(first, at, 0))
    rank[order] = head
    done = 7
    while True:
        open_at = np.flatnonzero(~(first & np.r_[first[1:], True]))
        if not len(open_at):
            return order
        rows = order[open_at]
        ahead = rank[np.minimum(rows + done, stop[rows])]
        again = np.lexsort((ahead, head[open_at]))
        order[open_at] = rows[again]
        group, ahead = head[open_at][again], ahead[again]
        first[open_at] = np.r_[True, (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])]
        head = np.maximum.accumulate(np.where(first, at, 0))
        rank[order] = head
        done *= 2


def kasai(codes: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to limit. Kasai's walk, one
    step of every window at a time: from a position to the next the prefix loses one code at
    most. No prefix crosses a separator."""
    n = len(codes)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    before = np.where(where > 0, order[where - 1], -1)
    common = np.zeros(n, np.int64)
    at, left, have = starts.copy(), ends, np.zeros(len(starts), np.int64)
    while len(at):
        other = before[at]
        grow = np.flatnonzero(other >= 0)
        have[other < 0] = 0
        while len(grow):
            a, b = at[grow] + have[grow], other[grow] + have[grow]
            grow = grow[(have[grow] < limit) & (a < n) & (b < n)]
            if not len(grow):
                break
            a, b = at[grow] + have[grow], other[grow] + have[grow]
            grow = grow[(codes[a] == codes[b]) & (codes[a] > 0)]
            have[grow] += 1
        common[at] = have
        have = np.maximum(have - 1, 0)
        on = at + 1 < left
        at, left, have = at[on] + 1, left[on], have[on]
    out = np.zeros(n, np.int64)
    out[where] = common
    return out


class Shard:
    """A suffix array over some windows."""

    def __init__(self, windows: list[bytes], width: int):
        self.width = width
        sizes = np.array([len(w) for w in windows], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        self.ends = self.starts + sizes
        codes = np.zeros(int(sizes.sum()) + len(windows), np.uint16)
        inside = np.ones(len(codes), bool)
        inside[self.ends] = False
        codes[inside] = np.frombuffer(b"".join(windows), np.uint8).astype(np.uint16) + 1
        self.codes = codes
        self.owner = np.repeat(np.arange(len(windows)), sizes + 1)
        self.order = suffix_array(codes, self.ends[self.owner])
        # Suffixes too short to hold a string of the width are of no use.
        self.fits = np.arange(len(codes)) + width <= self.ends[self.owner]

    def classes(self, doubled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, position) of suffixes whose first `width` bytes stand at several positions, or in a window that
        stands at several places (doubled)."""
        common = kasai(self.codes, self.order, self.starts, self.ends, self.width)
        label = np.cumsum(common < self.width)
        size = np.bincount(label)
        many = ((size[label] > 1) | doubled[self.owner[self.order]]) & self.fits[self.order]
        return label[many], self.order[many]

    def find(self, other: Shard, at: np.ndarray) -> np.ndarray:
        """For positions of another shard, a position here with the same first bytes, or -1."""
        mine = self.order[self.fits[self.order]]
        out = np.full(len(at), -1, np.int64)
        if not len(mine):
            return out
        width = np.arange(self.width)
        for i in range(0, len(at), 4096):
            want = other.codes[at[i : i + 4096, None] + width]
            low, high = np.zeros(len(want), np.int64), np.full(len(want), len(mine))
            while (low < high).any():
                mid = np.minimum((low + high) // 2, len(mine) - 1)
                have = self.codes[mine[mid][:, None] + width]
                differ = have != want
                place = differ.argmax(1)
                rows = np.arange(len(want))
                less = differ[rows, place] & (have[rows, place] < want[rows, place])
                go = low < high
                low = np.where(go & less, mid + 1, low)
                high = np.where(go & ~less, mid, high)
            hit = np.minimum(low, len(mine) - 1)
            same = (self.codes[mine[hit][:, None] + width] == want).all(1) & (low < len(mine))
            out[i : i + 4096] = np.where(same, mine[hit], -1)
        return out


def repeated_starts(windows: list[bytes], rids: np.ndarray, firsts: np.ndarray, doubled: np.ndarray, keys: np.ndarray, width: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset in it) of every string of the width that also stands elsewhere.

    Windows are sorted by key, and only those of one key need be compared. rids and firsts say
    where each window's first byte stands, so a string is not taken for its own copy when
    windows overlap; doubled marks windows that stand at several places as they are.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = [len(w) for w in windows]
    bounds = list(slices(sizes, shard_bytes))
    shards: list[tuple[int, int, Shard]] = []

    def places(base: int, shard: Shard, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = base + shard.owner[at]
        offset = at - shard.starts[shard.owner[at]]
        return w, offset, firsts[w] + offset

    for a, b in bounds:
        shard = Shard(windows[a:b], width)
        label, at = shard.classes(doubled[a:b])
        if len(at):
            w, offset, absolute = places(a, shard, at)
            # A class counts if it stands at two places, or in a window that does.
            order = np.lexsort((absolute, rids[w], label))
            l, r, p = label[order], rids[w][order], absolute[order]
            fresh = np.r_[True, (l[1:] != l[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1])]
            several = np.bincount(l, weights=fresh) > 1
            several |= np.bincount(label, weights=doubled[w], minlength=len(several)) > 0
            hit = several[label]
            found.append((w[hit], offset[hit]))
        # Shards that end within a key are merged with the earlier ones of that key.
        for base, last, earlier in shards:
            if keys[last - 1] == keys[a]:
                mine = np.flatnonzero(shard.fits & (keys[a + shard.owner] == keys[a]))
                other = earlier.find(shard, mine)
                hit = other >= 0
                w, offset, absolute = places(a, shard, mine[hit])
                v, back, there = places(base, earlier, other[hit])
                apart = (rids[w] != rids[v]) | (absolute != there)
                found += [(w[apart], offset[apart]), (v[apart], back[apart])]
                # Equal strings of the earlier shard lie side by side; all of them are repeated.
                again = shard.find(earlier, np.flatnonzero(earlier.fits & (keys[base + earlier.owner] == keys[a])))
                theirs = np.flatnonzero(earlier.fits & (keys[base + earlier.owner] == keys[a]))
                ok = again >= 0
                v, back, there = places(base, earlier, theirs[ok])
                w, offset, absolute = places(a, shard, again[ok])
                apart = (rids[w] != rids[v]) | (absolute != there)
                found += [(w[apart], offset[apart]), (v[apart], back[apart])]
        shards = [s for s in shards if keys[s[1] - 1] == keys[b - 1]]
        if b < len(windows) and keys[b] == keys[b - 1]:
            shards.append((a, b, shard))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([w for w, _ in found]), np.concatenate([o for _, o in found])


def spans_of(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The maximal runs that strings beginning at some starts cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > width) + 1
    return list(zip(starts[np.r_[0, new]].tolist(), (starts[np.r_[new - 1, len(starts) - 1]] + width).tolist()))


def runs_of(size: int, lead: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(run, a, b, c, d) of a window with its anchor at lead: the strings of the run start from a to b,
    and bytes c to d are in all of them. Runs are counted from the anchor, so equal strings fall into the same."""
    last = size - width
    for run in range((lead - last) // STEP, lead // STEP + 1):
        high = lead - run * STEP
        low = high - STEP + 1
        a, b = max(low, 0), min(high, last)
        if a <= b:
            yield run, a, b, high, low + width


def repeated_runs(windows: list[bytes], leads: list[int], many: list[bool], rids: np.ndarray, firsts: np.ndarray, keys: np.ndarray, width: int, shard_bytes: int) -> list[tuple[int, int, int]]:
    """(window, a, b): runs of bytes covered by repeated strings. Windows are sorted by key, and
    many marks windows that stand at several places."""
    middles: dict[tuple, list[tuple[int, int, int, int]]] = {}
    for i, (w, lead, k) in enumerate(zip(windows, leads, keys.tolist())):
        for run, a, b, c, d in runs_of(len(w), lead, width):
            middles.setdefault((k, run, w[c:d]), []).append((i, a, b, c))
    out: list[tuple[int, int, int]] = []
    pieces: list[bytes] = []
    members: list[list[tuple[int, int]]] = []
    groups: list[int] = []
    for g, met in enumerate(middles.values()):
        if len(met) < 2:
            continue
        kinds: dict[tuple, list[tuple[int, int]]] = {}
        for i, a, b, c in met:
            kinds.setdefault((c - a, windows[i][a : b + width]), []).append((i, a))
        if len(kinds) == 1:
            out += [(i, a, b + width) for i, a, b, _ in met]
            continue
        for (_, piece), same in kinds.items():
            pieces.append(piece)
            members.append(same)
            groups.append(g)
    if pieces:
        one = [m[0] for m in members]
        doubled = np.array([len(m) > 1 or many[m[0][0]] for m in members])
        at = np.array([firsts[i] + a for i, a in one], np.int64)
        w, o = repeated_starts(pieces, rids[[i for i, _ in one]], at, doubled, np.array(groups), width, shard_bytes)
        order = np.lexsort((o, w))
        w, o = w[order], o[order]
        for part in np.split(np.arange(len(w)), np.flatnonzero(np.diff(w)) + 1) if len(w) else []:
            spans = spans_of(o[part], width)
            out += [(i, a + x, a + y) for i, a in members[w[part[0]]] for x, y in spans]
    return out


def _shards(batches: Iterator[pa.RecordBatch], width: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of windows, sorted by k: spans of each, relative to the whole window."""
    held: list[pa.RecordBatch] = []

    def solve(rows: pa.Table) -> pa.RecordBatch:
        windows, leads = rows.column("window").to_pylist(), rows.column("lead").to_pylist()
        num = {c: rows.column(c).to_numpy() for c in ("k", "rid", "first", "n", "base", "h", "w1", "w2")}
        found = repeated_runs(windows, leads, (num["n"] > 1).tolist(), num["rid"], num["first"].astype(np.int64), num["k"], width, shard_bytes)
        i, a, b = np.array(found, np.int64).reshape(-1, 3).T
        base = num["base"][i]
        return pa.RecordBatch.from_arrays(
            [pa.array(num["h"][i]), pa.array(num["w1"][i]), pa.array(num["w2"][i]), pa.array((a + base).astype(np.int32)), pa.array((b + base).astype(np.int32))],
            names=["h", "w1", "w2", "a", "b"],
        )

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size > 4 * shard_bytes:
            rows = pa.Table.from_batches(held)
            k = rows.column("k").to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield solve(rows.slice(0, cut))
            rest = rows.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
    if held:
        yield solve(pa.Table.from_batches(held))


# ---- the operator

_WINDOW = "h bigint, w1 bigint, w2 bigint, rid bigint, first int, n bigint, lead int, base int, window binary"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _window_batch(rows: list[tuple], schema: str = _WINDOW) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, kinds)], names=names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows t, picks (first, size, lead, h, w1, w2, n): the bytes of each picked window."""
    for batch in batches:
        texts, picks, rids = batch.column("t").to_pylist(), batch.column("picks").to_pylist(), batch.column("rid").to_pylist()
        out: list[tuple] = []
        size = 0
        for t, some, rid in zip(texts, picks, rids):
            for p in some:
                out.append((p["h"], p["w1"], p["w2"], rid, p["first"], p["n"], p["lead"], 0, t[p["first"] : p["first"] + p["size"]]))
                size += p["size"]
                if size > 1 << 22:
                    yield _window_batch(out)
                    out, size = [], 0
        yield _window_batch(out)


def _cores(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The runs of each window of a crowded anchor, under the hash of their middles."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            w = row["window"]
            for run, a, b, c, d in runs_of(len(w), row["lead"], width):
                key = xxh3_64_intdigest(w[c:d] + run.to_bytes(2, "little", signed=True), row["h"] & (1 << 63) - 1)
                out.append((key - (1 << 64) if key >= 1 << 63 else key, row["h"], row["w1"], row["w2"], row["rid"], row["first"] + a, row["n"], row["lead"] - a, a, w[a : b + width]))
        yield _window_batch(out, "k bigint, " + _WINDOW)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc_id, t, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "spans"))):
            t = t or b""
            runs: list[list[int]] = []
            for s in sorted((s["a"], s["b"]) for s in spans or []):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(t[at:a])
                at = b
            digest.update(t[at:])
            out.append((doc_id, len(t), sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(docs: DataFrame) -> DataFrame:
    """Rows rid, doc_id, t. The rid tells rows apart. It comes from how the plan splits its files, so it is
    written once: every later read sees the same, whatever cores are there by then."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t")))


def repeated_spans(rows: DataFrame, width: int = 200, shard_bytes: int = 1 << 20, crowd: int = 2048) -> DataFrame:
    """rows (rid, t binary): spans rid, a, b of repeated strings; they may overlap."""
    texts = rows.select("rid", "t")
    made = materialise(texts.mapInArrow(lambda it: _anchor_rows(it, width), _PLACE))
    often = made.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    places = materialise(made.join(often, "h"))
    discard(made)
    kinds = materialise(places.groupBy("h", "w1", "w2").agg(F.min(F.struct("rid", "first", "size", "lead")).alias("one"), F.count("*").alias("n")))
    many = kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    picks = kinds.join(many, "h").select("h", "w1", "w2", "n", "one.*")
    by_row = picks.groupBy("rid").agg(F.collect_list(F.struct("first", "size", "lead", "h", "w1", "w2", "n")).alias("picks"))
    windows = materialise(texts.join(by_row, "rid").mapInArrow(_windows, _WINDOW))
    crowded = materialise(many.where(F.col("m") > crowd).select("h"))
    solve = lambda it: _shards(it, width, shard_bytes)
    spans_schema = "h bigint, w1 bigint, w2 bigint, a int, b int"
    plain = windows.join(crowded, "h", "left_anti").select(F.col("h").alias("k"), "*")
    found = plain.repartition("k").sortWithinPartitions("k").mapInArrow(solve, spans_schema)
    if not crowded.isEmpty():
        cores = windows.join(crowded, "h").select(*[c.split()[0] for c in _WINDOW.split(", ")]).mapInArrow(lambda it: _cores(it, width), "k bigint, " + _WINDOW)
        cores = materialise(cores)
        shared = cores.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
        found = found.union(cores.join(shared, "k", "left_semi").repartition("k").sortWithinPartitions("k").mapInArrow(solve, spans_schema))
    whole = kinds.where("n > 1").select("h", "w1", "w2", F.lit(0).alias("a"), F.col("one.size").alias("b"))
    # A window that is repeated as a whole needs no other spans.
    found = materialise(found.join(whole, ["h", "w1", "w2"], "left_anti").union(whole))
    return places.join(found, ["h", "w1", "w2"]).select("rid", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def suffix_duplicates(docs: DataFrame, width: int = 200, shard_bytes: int = 1 << 20, crowd: int = 2048) -> DataFrame:
    """Rows doc_id, n_bytes, n_removed, n_spans, kept_sha256: one for each row of docs."""
    rows = numbered(docs)
    spans = repeated_spans(rows, width, shard_bytes, crowd).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    met = rows.join(spans, "rid", "left").select("doc_id", "t", "spans")
    return met.mapInArrow(_finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
