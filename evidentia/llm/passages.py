"""Substring dedup: shared k-mer seeds, collinear chaining with gap costs, and alignment of the chains into fuzzy passages."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidentia.llm.shared import WORD, by_id, dealt, materialize, partitions, python_workers
from evidentia.llm.text_hash import STEP, Words, grams, mix

#: Words a short seed. MIN_WORDS words with at most 10 words changed, left out or put in keep 50 + 1 - 4 * (10 + 1) = 7 of their short seeds
#: or more, since a change spoils at most 4. Half of them, chosen by their hash alone and so alike in both texts, look for partners.
SHORT, LEAST_CHAIN = 4, 3
#: Words a long seed; one is kept of every WINDOW neighbours (the least hash), so equal runs of LONG + WINDOW - 1 = 55 words share one. Whoever has a
#: long seed has MIN_WORDS equal words, so no document with less of a passage can stand between two that have it.
LONG, WINDOW = 50, 6
#: Short seeds make two documents partners if two of them lie so many words apart, in the same order, in both.
SPREAD, WITHIN = 12, 50
#: Bits of a seed's hash that are compared, ranges of hashes a shuffle partition, and seeds packed at once.
KEY_BITS, RANGES, BLOCK = 48, 2, 4_000_000
#: A short seed with up to so many places in the other text is matched with all of them, others with the first, the last and the one of its own rank.
PLACES = 4
#: Score lost for each word stepped over on either side between two runs of a chain, and the longest step.
GAP_COST, MAX_GAP = 0.1, 64
#: A passage has at least so many words, of which this share match.
MIN_WORDS, IDENTITY = 50, 0.8
#: An extension ends where its score has dropped this far below its best (a match scores 1, a mismatch -2).
DROP = 12
#: An alignment steps over at most so many words of either side at a difference, to where so many words match again.
BAND, RESUME = 32, 3
#: An extension steps over at most so many words of either side.
SKIP = 4
#: Up to so many texts with copies (32 bytes each) are broadcast to leave the copies out; beyond it they are joined by a shuffle.
BROADCAST_COPIES = 500_000


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a * STEP) ^ mix(b + STEP))


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, 2 * place + is long) of the seeds of a text that look for partners, in order of place."""
    four = grams(words, SHORT)
    at = np.flatnonzero((four & np.uint64(1)) == 0)
    key, code = four[at], 2 * at
    if len(words) >= LONG:
        eight = _paired(four[:-4], four[4:])
        sixteen = _paired(eight[:-8], eight[8:])
        half = _paired(sixteen[:-9], sixteen[9:])  # 25 words
        far = _paired(half[:-25], half[25:])
        if len(far) <= WINDOW:
            least = np.array([int(np.argmin(far))])
        else:
            views = np.lib.stride_tricks.sliding_window_view(far, WINDOW)
            least = np.unique(np.argmin(views, axis=1) + np.arange(len(views)))
        key, code = np.concatenate([key, far[least]]), np.concatenate([code, 2 * least + 1])
        order = np.argsort(code, kind="stable")
        key, code = key[order], code[order]
    return key >> np.uint64(64 - KEY_BITS), code


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed byte by byte, so that high bytes that are mostly equal take no room."""
    return pa.compress(b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, columns: int) -> list[np.ndarray]:
    """What ``_packed`` was given: ``columns`` of length ``n``."""
    raw = np.frombuffer(pa.decompress(blob, 8 * n * columns, "zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(raw[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T).view("<i8").ravel() for k in range(columns)]


def _linked(order: np.ndarray, key: np.ndarray, doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, ends, links): ``order``, which sorts by key and document, with the first place only of each; ends marks a key's first and last document.

    links are (doc, ref, pos, ref_pos, long): each document of a key with the key's first one and with the next smaller one."""
    k, d = key[order], doc[order]
    own = np.ones(len(k), bool)
    own[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    order = order[own]
    k, d, c = key[order], doc[order], code[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    later = np.flatnonzero(~new)
    x = np.concatenate([later, later[later - 1 != first[later]]])
    y = np.concatenate([first[later], (later - 1)[later - 1 != first[later]]])
    last = np.append(new[1:], True) if len(k) else new
    return order, new | last, (d[x], d[y], c[x] >> 1, c[y] >> 1, c[x] & 1)


def _bucketed(links: tuple[np.ndarray, ...], parts: int) -> list[tuple]:
    """Rows (part, kind 1, n, blob) of ``links``, dealt to ``parts`` by a hash of the pair."""
    pair = _paired(links[0].view(np.uint64), links[1].view(np.uint64)) >> np.uint64(32)
    order = np.argsort(pair, kind="stable")
    edges = np.array([-(-(r << 32) // parts) for r in range(parts + 1)], np.uint64)
    cuts, columns = np.searchsorted(pair[order], edges), [c[order] for c in links]
    return [(r, 1, int(j - i), _packed(*(c[i:j] for c in columns))) for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]


_ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
_PACKED = "part int, kind int, n long, blob binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ROWS.types)], schema=_ROWS)


def seed_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """(part, kind, n, blob) of docs (doc_id, t). Kind 0: seeds, in RANGES * ``parts`` ranges of their hashes. Kind 1: links among documents of one
    block, dealt to ``parts`` by pair.

    A block is what one task reads until it has BLOCK seeds. A seed that many documents of a block have is linked there, and only its first and last
    document go on, so a seed in a third of all documents costs its range two places a block and not one a document.
    """
    python_workers(docs.sparkSession)
    ranges = RANGES * parts
    edges = np.array([-(-(r << KEY_BITS) // ranges) for r in range(ranges + 1)], np.uint64)

    def block(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        key = np.concatenate([x[1] for x in held])
        doc = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
        code = np.concatenate([x[2] for x in held])
        order, ends, links = _linked(np.argsort(key, kind="stable"), key, doc, code)
        order = order[ends]
        key, doc, code = key[order], doc[order], code[order]
        cuts, rows = np.searchsorted(key, edges), _bucketed(links, parts)
        for r in range(ranges):
            i, j = int(cuts[r]), int(cuts[r + 1])
            if i < j:
                rows.append((r, 0, j - i, _packed(np.diff(key[i:j].view(np.int64), prepend=0), doc[i:j], code[i:j])))
        return _batch(rows)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Words(), [], 0
        for batch in rows:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key, code = seeds(words.hashes(t.as_py()))
                if len(key):
                    held.append((i, key, code))
                    n += len(key)
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return docs.select("doc_id", "t").mapInArrow(run, _PACKED)


def _by_part(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its rows) of rows that are sorted by part."""
    part, held = None, []
    for batch in rows:
        for r, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if r != part and held:
                yield part, held
                held = []
            part = r
            held.append(row)
    if held:
        yield part, held


def _partners(doc: np.ndarray, ref: np.ndarray, pos: np.ndarray, ref_pos: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places, in links sorted by pair and pos, that show a pair to be partners."""
    shown = far > 0
    for lag in (1, 2, 3, 4, 6, 8, 12):
        if lag < len(doc):
            dx, dy = pos[lag:] - pos[:-lag], ref_pos[lag:] - ref_pos[:-lag]
            same = (doc[lag:] == doc[:-lag]) & (ref[lag:] == ref[:-lag])
            shown[lag:] |= same & (dx >= SPREAD) & (dx <= WITHIN) & (dy >= SPREAD // 2) & (dy <= WITHIN + SPREAD)
    return shown


def partners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ref_doc), ref_doc being smaller: documents that share a long seed, or two short ones SPREAD to WITHIN words apart.

    Every document of a seed is linked with the first one that has it and with the next smaller one, in its block and then among blocks: so a seed of n
    documents gives at most 2 n links and not all pairs, and a document that has only a part of a passage does not hide the rest. Seeds and links
    are exchanged once each, packed into few rows.
    """
    docs = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    parts = partitions(docs.sparkSession)

    def link(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[np.ndarray, ...]] = []
        for part, held in _by_part(rows):
            if passed := [(part, *r) for r in held if r[0] == 1]:
                yield _batch(passed)
            found = [_unpacked(blob, n, 3) for kind, n, blob in held if kind == 0]
            if found:
                key = np.concatenate([np.cumsum(f[0]) for f in found]).view(np.uint64)
                doc, code = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                ready.append(_linked(np.lexsort((doc, key)), key, doc, code)[2])
            if sum(len(r[0]) for r in ready) >= BLOCK:
                yield _batch(_bucketed(tuple(map(np.concatenate, zip(*ready, strict=True))), parts))
                ready = []
        if any(len(r[0]) for r in ready):
            yield _batch(_bucketed(tuple(map(np.concatenate, zip(*ready, strict=True))), parts))

    def choose(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_part(rows):
            found = [_unpacked(blob, n, 5) for _, n, blob in held]
            columns = [np.concatenate([f[k] for f in found]) for k in range(5)]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            doc, ref, *rest = (c[order] for c in columns)
            at = np.flatnonzero(_partners(doc, ref, *rest))
            pairs = np.unique(np.stack([doc[at], ref[at]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["doc_id", "ref_doc"])

    ranges = dealt(seed_ranges(docs, parts), "part").sortWithinPartitions("part").mapInArrow(link, _PACKED)
    return dealt(ranges, "part").sortWithinPartitions("part").mapInArrow(choose, "doc_id long, ref_doc long")


class Fenwick:
    """Prefix maxima of (value, index) over ranks from 0."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, rank: int, item: tuple[float, int]) -> None:
        i = rank + 1
        while i < len(self.best):
            if self.best[i] < item:
                self.best[i] = item
            i += i & -i

    def below(self, rank: int) -> tuple[float, int]:
        """The largest among ranks smaller than ``rank``."""
        out = self.best[0]
        while rank:
            out = max(out, self.best[rank])
            rank -= rank & -rank
        return out


def scored(runs: list[tuple[int, int, int]], slack: int = SHORT - 1) -> tuple[list[float], list[int]]:
    """(scores, predecessors or -1) of equal runs (start, ref_start, words), sorted by start.

    A run may follow one that ends at most ``slack`` words past its own start, on both sides. A chain scores its runs' words less GAP_COST for each word
    between runs on either side. Moving that cost into the runs' own coordinates leaves a prefix maximum over the ends in the other text, which a
    Fenwick tree gives; so n runs take n log n steps.
    """
    n = len(runs)
    score, before = [float(r[2]) for r in runs], [-1] * n
    if n < 2:
        return score, before
    ends = sorted({y + w - slack for _, y, w in runs})
    tree, k = Fenwick(len(ends)), 0
    leaving = sorted(range(n), key=lambda j: runs[j][0] + runs[j][2])
    for i, (x, y, w) in enumerate(runs):
        while k < n and runs[leaving[k]][0] + runs[leaving[k]][2] - slack <= x:
            j = leaving[k]
            a, b = runs[j][0] + runs[j][2], runs[j][1] + runs[j][2]
            tree.put(bisect_left(ends, b - slack), (score[j] + GAP_COST * (a + b), j))
            k += 1
        value, j = tree.below(bisect_right(ends, y))
        gained = value - GAP_COST * (x + y)
        if gained > 0:
            score[i], before[i] = w + gained, j
    return score, before


def chains(runs: list[tuple[int, int, int]]) -> list[list[int]]:
    """The runs of each chain in order, best chains first; a chain is cut where it steps over more than MAX_GAP words."""
    score, before = scored(runs)
    out, used = [], [False] * len(runs)
    for end in sorted(range(len(runs)), key=lambda k: -score[k]):
        k, chain = end, []
        while k >= 0 and not used[k]:
            used[k] = True
            if chain:
                after, own = runs[chain[-1]], runs[k]
                if max(after[0] - own[0], after[1] - own[1]) - own[2] > MAX_GAP:
                    out.append(chain[::-1])
                    chain = []
            chain.append(k)
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


def equal_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, ref_start, words) of the runs of equal words in two texts' word hashes, from their short seeds, sorted by start."""
    x, y = grams(a, SHORT), grams(b, SHORT)
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    n = high - low
    few = np.flatnonzero((n > 0) & (n <= PLACES))
    counts = n[few]
    pos = [np.repeat(few, counts)]
    at = [np.repeat(low[few], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)]
    many = np.flatnonzero(n > PLACES)
    if len(many):
        turn = many[np.argsort(low[many], kind="stable")]
        start = np.concatenate([[True], low[turn][1:] != low[turn][:-1]])
        rank = np.arange(len(turn)) - np.maximum.accumulate(np.where(start, np.arange(len(turn)), 0))
        pos += [turn, turn, turn]
        at += [low[turn], high[turn] - 1, np.minimum(low[turn] + rank, high[turn] - 1)]
    p, q = np.concatenate(pos), order[np.concatenate(at)]
    if not len(p):
        return p, q, p
    turn = np.lexsort((p, q - p))
    p, q = p[turn], q[turn]
    new = np.concatenate([[True], (np.diff(q - p) != 0) | (np.diff(p) > SHORT)])
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(p)) - 1
    s, r, w = p[first], q[first], p[last] - p[first] + SHORT
    turn = np.lexsort((r, s))
    return s[turn], r[turn], w[turn]


def _seeds_in(chain: list[tuple[int, int, int]]) -> int:
    return sum(w - SHORT + 1 for _, _, w in chain)


def long_chains(a: np.ndarray, b: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The chains of two texts' equal runs (start, ref_start, words) that hold LEAST_CHAIN seeds or more."""
    runs = list(zip(*(c.tolist() for c in equal_runs(a, b)), strict=True))
    found = [[runs[k] for k in chain] for chain in chains(runs)]
    return [c for c in found if _seeds_in(c) >= LEAST_CHAIN]


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, matches) by which two texts go on alike from their start."""
    n, best, at, score, hits, total = min(len(a), len(b)), 0, 0, 0, 0, 0
    for i in range(0, n, 256):
        same = a[i : min(i + 256, n)] == b[i : min(i + 256, n)]
        run = score + np.cumsum(np.where(same, 1, -2))
        peak = np.maximum(np.maximum.accumulate(run), best)
        stop = np.flatnonzero(run < peak - DROP)
        m = int(stop[0]) if len(stop) else len(run)
        if m and run[:m].max() > best:
            k = int(np.argmax(run[:m]))
            best, at, hits = int(run[k]), i + k + 1, total + int(same[: k + 1].sum())
        if len(stop):
            break
        score, total = int(run[-1]), total + int(same.sum())
    return at, hits


def _grown(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, words of b, matches) by which two texts go on alike from their start, over up to SKIP words that only one of them has."""
    i = j = total = 0
    while True:
        n, hits = _extend(a[i:], b[j:])
        i, j, total = i + n, j + n, total + hits
        x, y = a[i : i + SKIP + RESUME], b[j : j + SKIP + RESUME]
        if len(x) < RESUME or len(y) < RESUME:
            return i, j, total
        grid = x[:, None] == y[None, :]
        w, h = grid.shape[0] - RESUME + 1, grid.shape[1] - RESUME + 1
        at = np.argwhere(np.logical_and.reduce([grid[k : k + w, k : k + h] for k in range(RESUME)]))
        if not len(at):
            return i, j, total
        di, dj = at[np.argmin(at.sum(axis=1))]
        i, j = i + int(di), j + int(dj)


def _aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Words of ``a`` matched in order with words of ``b``.

    Equal runs are taken whole; at a difference the alignment goes on at the nearest place, in words left out of both, where RESUME words match
    again within BAND words. So the cost follows the number of differences and not the product of the lengths.
    """
    i = j = matched = 0
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j, 512)
        same = a[i : i + n] == b[j : j + n]
        run = n if same.all() else int(np.argmin(same))
        matched, i, j = matched + run, i + run, j + run
        if run == n:
            continue
        x, y = a[i : i + BAND + RESUME], b[j : j + BAND + RESUME]
        if len(x) < RESUME or len(y) < RESUME:
            return matched + int((x[: len(y)] == y[: len(x)]).sum())
        grid = x[:, None] == y[None, :]
        w, h = grid.shape[0] - RESUME + 1, grid.shape[1] - RESUME + 1
        again = np.logical_and.reduce([grid[k : k + w, k : k + h] for k in range(RESUME)])
        at = np.argwhere(again)
        if len(at):
            di, dj = at[np.argmin(at.sum(axis=1))]
            matched += int((x[: min(di, dj)] == y[: min(di, dj)]).sum())
        else:
            di, dj = w, h
        i, j = i + int(di), j + int(dj)
    return matched


def _stretched(a: np.ndarray, b: np.ndarray, p: tuple[int, int, int, int, int]) -> tuple[int, int, int, int, int]:
    """The passage ``p``, if it is too short, with the fewest words beside it that make MIN_WORDS of which IDENTITY match.

    An extension ends at its best score, so it leaves out one or two like words after an unlike one, which a passage of few words may need."""
    s, e, rs, re, m = p
    least, most = min(e - s, re - rs), max(e - s, re - rs)
    if least >= MIN_WORDS:
        return p
    i, j = min(s, rs, MIN_WORDS - least), min(len(a) - e, len(b) - re, MIN_WORDS - least)
    if least + i + j < MIN_WORDS:
        return p
    left = np.concatenate([[True], (a[s - i : s] == b[rs - i : rs])[::-1]])
    right = np.concatenate([[True], a[e : e + j] == b[re : re + j]])
    more = np.add.outer(np.arange(i + 1), np.arange(j + 1))
    hits = m + np.add.outer(np.cumsum(left) - 1, np.cumsum(right) - 1)
    able = np.logical_and.outer(left, right) & (least + more >= MIN_WORDS) & (hits >= IDENTITY * (most + more))
    if not able.any():
        return p
    i, j = np.unravel_index(int(np.argmin(np.where(able, more, 1 << 30))), more.shape)
    return s - int(i), e + int(j), rs - int(i), re + int(j), int(hits[i, j])


def align(a: np.ndarray, b: np.ndarray, found: list[list[tuple[int, int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, ref_start, ref_end, matched) of the passages that the chains ``found`` grow into.

    A chain is aligned inside, extended over both ends, and is a passage if it then has MIN_WORDS words of which IDENTITY match. One that is not is cut at
    its longest step, and its parts are tried."""
    out = set()
    todo = sorted(found, reverse=True)
    while todo:
        chain = todo.pop()
        (s, rs, _), (e, re, w) = chain[0], chain[-1]
        e, re = e + w, re + w
        if _seeds_in(chain) < LEAST_CHAIN or any(o[0] <= s and e <= o[1] and o[2] <= rs and re <= o[3] for o in out):
            continue
        inner = _aligned(a[s:e], b[rs:re])
        for grow in (_grown, lambda x, y: ((m := _extend(x, y))[0], *m)):
            (left, ref_left, hits_left), (right, ref_right, hits_right) = grow(a[:s][::-1], b[:rs][::-1]), grow(a[e:], b[re:])
            p = _stretched(a, b, (s - left, e + right, rs - ref_left, re + ref_right, inner + hits_left + hits_right))
            longest = max(p[1] - p[0], p[3] - p[2])
            if min(p[1] - p[0], p[3] - p[2]) >= MIN_WORDS and p[4] >= IDENTITY * longest:
                out.add(p)
                break
        else:
            if len(chain) > 1:
                steps = [max(y[0] - x[0], y[1] - x[1]) - x[2] for x, y in zip(chain, chain[1:], strict=False)]
                k = max(range(len(steps)), key=steps.__getitem__) + 1
                todo += [chain[k:], chain[:k]]
    return sorted(out)


def copies(docs: DataFrame) -> DataFrame:
    """(h1, h2, first, n_words) of texts that several rows of docs (doc_id, t, h1, h2) have; first is the smallest doc_id."""
    many = docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return materialize(many.select("h1", "h2", "first"), "copies")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, ref_doc, ref_start, ref_end, matched), in words: every passage of a document that an earlier one (by id) has too.

    A passage has at least MIN_WORDS words, of which IDENTITY match in order. A document with the text of an earlier one has one passage, the whole of
    it; other documents are compared with their partners: all short seeds of the two texts are matched, merged into equal runs, chained, and the
    chains aligned and extended. Repeats inside one document are not passages. Null, empty and short texts have none; rows with a null
    doc_id are left out; rows that repeat a doc_id are not compared with each other.
    """
    docs = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    hashed = docs.withColumn("h1", F.xxhash64("t")).withColumn("h2", F.xxhash64(F.lit("text"), "t")).filter(F.length("t") > 0)
    same = copies(hashed.select("doc_id", "h1", "h2"))
    small = same.count() <= BROADCAST_COPIES
    known = hashed.join(F.broadcast(same) if small else same, ["h1", "h2"], "left")
    single = known.filter("first IS NULL OR first = doc_id").select("doc_id", "t")
    n = F.coalesce(F.regexp_count(F.col("t").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    whole = known.filter("first < doc_id").select("doc_id", zero.alias("start"), n.alias("end"), F.col("first").alias("ref_doc"), zero.alias("ref_start"), n.alias("ref_end"), n.alias("matched")).filter(F.col("end") >= MIN_WORDS)
    pairs = materialize(partners(single, "doc_id", "t"), "partners")
    ids = materialize(pairs.select(F.explode(F.array("doc_id", "ref_doc")).alias("doc_id")).distinct(), "partner-ids")
    texts = materialize(by_id(single, ids, "doc_id"), "partner-texts")
    both = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("ref_doc"), F.col("t").alias("rt")), "ref_doc")
    names = ("doc_id", "start", "end", "ref_doc", "ref_start", "ref_end", "matched")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, schema, last, held = Words(), pa.schema([(n, pa.int64()) for n in names]), None, None
        for batch in rows:
            out = []
            for d, r, t, rt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                own, ref = words.hashes(t.as_py()), held if rt == last else words.hashes(rt.as_py())
                last, held = rt, ref  # rows come by ref_doc
                for s, e, rs, re, m in align(own, ref, long_chains(own, ref)):
                    out.append(dict(zip(names, (d, s, e, r, rs, re, m), strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema)

    found = both.select("doc_id", "ref_doc", "t", "rt").mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
    return _first_found(found).unionByName(whole)


def _first_found(found: DataFrame) -> DataFrame:
    """``found`` without passages whose words all lie in passages of the same document with smaller ref_docs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = ref = None
        known, fresh = [], []  # disjoint spans in order, of smaller ref_docs; spans of this one
        for batch in rows:
            keep = []
            for d, s, e, r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if d != doc:
                    known, fresh = [], []
                elif r != ref:
                    merged = []
                    for x, y in sorted(known + fresh):
                        if merged and x <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
                        else:
                            merged.append((x, y))
                    known, fresh = merged, []
                doc, ref = d, r
                i = bisect_left(known, (s + 1,)) - 1
                keep.append(i < 0 or known[i][1] < e)
                if keep[-1]:
                    fresh.append((s, e))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt(found, "doc_id").sortWithinPartitions("doc_id", "ref_doc", "start", "end").mapInArrow(run, found.schema)


def _covered(spans: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["last"]))).alias("n"), F.greatest(a["last"], x["e"]).alias("last"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_dup_words, n_source_words, ref_docs, passages) of every row.

    n_dup_words: words in passages that an earlier document has; ref_docs and passages: those documents and the spans. n_source_words: words in
    passages that later documents repeat. The lists of a document are bounded by its own words, however many documents share its passages.
    """
    found = materialize(passages(docs, doc_id, text), "passages")
    span = F.struct(F.col("start").alias("s"), F.col("end").alias("e"))
    own = found.groupBy("doc_id").agg(_covered(F.collect_set(span)).alias("n_dup_words"), F.array_sort(F.collect_set("ref_doc")).alias("ref_docs"), F.array_sort(F.collect_set(F.struct("start", "end", "ref_doc", "ref_start", "ref_end", "matched"))).alias("passages"))
    longest = found.groupBy(F.col("ref_doc").alias("doc_id"), F.col("ref_start").alias("s")).agg(F.max("ref_end").alias("e"))
    source = longest.groupBy("doc_id").agg(_covered(F.collect_list(F.struct("s", "e"))).alias("n_source_words"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return rows.join(own, "doc_id", "left").join(source, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_dup_words", zero).alias("n_dup_words"), F.coalesce("n_source_words", zero).alias("n_source_words"), "ref_docs", "passages"
    )
