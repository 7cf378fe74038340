"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A public BPE model's pieces and scores are applied by an agenda of candidate
merges, best score first, leftmost first on ties.  With dropout each candidate of
each segment is skipped on its own at the rate, keyed by seed, document and
place, so the same seed always gives the same segmentation and other seeds,
documents or places give others.

How many candidates pass before the next skip is drawn at once.  What a segment
becomes without a skip, or with its first few skips at given candidates, does
not depend on the place and is cached; further skips are worked out in place.
Cached results lie in flat arrays, and segments of one length are merged side by
side, so that little is done for each segment alone.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import mix64

SPACE = "▁"
# Pieces hold a space mark at their start only, and no line end, so that merges
# never cross these segments (checked when a model is loaded).
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")
_M64 = (1 << 64) - 1
SKIPS, LONG = 3, 48     # skips of a segment that are cached, and up to which length
SLICE = 1000     # rows whose tokens are held and handed over at a time
CHUNK = 32768    # segments merged side by side


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype, width: tuple[int, ...] = ()):
        self._all, self._n = np.empty((1024, *width), dtype), 0

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, k):
        return self._all[:self._n][k]

    def extend(self, rows) -> None:
        end = self._n + len(rows)
        if end > len(self._all):
            more = np.empty((max(end, 2 * len(self._all)), *self._all.shape[1:]), self._all.dtype)
            more[:self._n] = self._all[:self._n]
            self._all = more
        self._all[self._n:end] = rows
        self._n = end


class _Ragged:
    """Arrays of int32 or uint32 one behind the other; item k is the k-th."""

    def __init__(self, dtype):
        self.flat, self.start, self.size = _Column(dtype), _Column(np.int64), _Column(np.int64)

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, k) -> np.ndarray:
        return self.flat[self.start[k]:self.start[k] + self.size[k]]

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.start.extend(len(self.flat) + np.cumsum(sizes) - sizes)
        self.size.extend(sizes)
        self.flat.extend(flat)

    def take(self, which: np.ndarray) -> np.ndarray:
        """The items ``which`` one behind the other."""
        return self.flat[_spread(self.start[which], self.size[which])]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers start, start + 1, ... (``size`` of them) of each entry, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Tokenizer:
    """Pieces of a BPE model with byte fallback; small enough to travel to every task."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], alpha: float = 0.1,
                 seed: int = 42, cache_size: int = 800_000):
        if not 0 <= alpha <= 1:
            raise ValueError("alpha is a probability")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.alpha, self.seed = alpha, seed
        self.cache_size = cache_size
        special = set(byte_ids)
        self.ids = {p: i for i, p in enumerate(pieces) if i > 2 and i not in special}
        self.cost = {p: -scores[i] for p, i in self.ids.items()}
        for p in self.ids:
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} crosses a segment border")
        self.under = int(alpha * 2.0 ** 64)
        self.text = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.text[i] = bytes([b])
        self._forget()
        self._make_tables()

    @classmethod
    def load(cls, path: str, **kw) -> "Tokenizer":
        """Read a ``.model`` file (on the driver; tasks get the pieces)."""
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)],
                   [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], **kw)

    def __reduce__(self):
        scores = [0.0] * len(self.pieces)
        for p, i in self.ids.items():
            scores[i] = -self.cost[p]
        return Tokenizer, (self.pieces, scores, self.byte_ids, self.alpha, self.seed, self.cache_size)

    def _make_tables(self) -> None:
        """Arrays of the same rules: character ids, and the piece each pair of pieces makes."""
        self.char_ids = np.full(1 << 16, -1, np.int32)
        found = {}
        for p, i in self.ids.items():
            if len(p) == 1 and ord(p) < 1 << 16:
                self.char_ids[32 if p == SPACE else ord(p)] = i
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = i
        self.char_ids[ord(SPACE)] = -1
        # A piece's rank is its place by cost: the agenda's order, and its name below.
        order = sorted(self.ids.values(), key=lambda i: (self.cost[self.pieces[i]], i))
        rank = {i: k for k, i in enumerate(order)}
        self.by_rank = np.array([*order, -1], np.int32)
        self._hash_pairs(np.array([*found], np.int64), np.array([rank[i] for i in found.values()], np.int32))
        plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.piece_chars = _Ragged(np.uint32)
        self.piece_chars.extend(_code_points(plain), np.array([len(p) for p in plain], np.int64))
        # Among pieces of equal cost the leftmost wins: such segments go one by one.
        equal, seen = set(), {}
        for i in set(found.values()):
            c = self.cost[self.pieces[i]]
            equal |= {self.pieces[i], self.pieces[seen.setdefault(c, i)]} if c in seen else set()
            seen.setdefault(c, i)
        self.tied = re.compile("|".join(re.escape(p.replace(SPACE, " ")) for p in sorted(equal))) if equal else None

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open table of pairs, at most a quarter full; a taken slot moves a pair to the next."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.slot_shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, len(self.by_rank) - 1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            at, first = np.unique(slot, return_index=True)
            first = first[self.slot_key[at] < 0]
            self.slot_key[slot[first]], self.slot_rank[slot[first]] = keys[first], ranks[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) % (1 << bits)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.slot_shift).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece each pair makes; the number of ranks if it makes none."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        held, rank = self.slot_key[slot], self.slot_rank[slot]
        go = np.flatnonzero((held != keys) & (held >= 0))
        keys, slot = keys.ravel()[go], slot.ravel()[go]
        flat = rank.reshape(-1)
        while len(go):
            slot = (slot + 1) % len(self.slot_key)
            held = self.slot_key[slot]
            flat[go] = self.slot_rank[slot]
            on = (held != keys) & (held >= 0)
            go, keys, slot = go[on], keys[on], slot[on]
        return rank

    def _characters(self, codes: np.ndarray) -> np.ndarray:
        """Ids of single characters; -1 without one."""
        return np.where(codes < 1 << 16, self.char_ids[np.minimum(codes, (1 << 16) - 1)], np.int32(-1))

    def many_ids(self, segments: list[str], stream: int) -> list[bytes]:
        """``segment_ids`` of segments of one length, all at once, as int32 bytes."""
        codes = _code_points(segments).reshape(len(segments), -1)
        plain = (self._characters(codes) >= 0).all(axis=1)
        tail = _keys(codes, self.seed, stream)[plain] if self.under else None
        flat, sizes, _ = self._merge_many(codes[plain], np.full((int(plain.sum()), 0), -1), tail)
        found = iter(np.split(flat, np.cumsum(sizes)[:-1]))
        return [(next(found) if p else np.array(self.segment_ids(s, stream), np.int32)).tobytes()
                for p, s in zip(plain.tolist(), segments)]

    def _merge_many(self, codes: np.ndarray, skips: np.ndarray, tail: np.ndarray | None):
        """``_merge`` of segments of one length whose characters all are pieces: the
        ids one behind the other, and the numbers of ids and of candidates.

        Columns are segments, rows are places.  A symbol sits at its first place
        and knows its neighbours' places; a candidate is its rank, then its place.
        Each round applies or skips the best candidate of every segment.
        """
        n, length = codes.shape
        none, shift = len(self.by_rank) - 1, length.bit_length()
        wide = np.int32 if (none + 1) << shift < 1 << 31 else np.int64
        ids = np.ascontiguousarray(self._characters(codes).T)
        out, steps = ids.copy(), np.zeros(n, np.int32)
        place = np.arange(length, dtype=np.int32)[:, None]
        idle = wide(none << shift)
        best = np.full((length, n), idle, wide)
        if length > 1:
            best[:-1] = self._pairs(ids[:-1], ids[1:]).astype(wide) << shift | place[:-1]
        after, before = np.repeat(place + 1, n, axis=1), np.repeat(place - 1, n, axis=1)
        last_skip = skips.max(axis=1, initial=-1)
        any_skip, skips, where, step = (last_skip >= 0).any(), skips.T, np.arange(n), -1
        while n:
            top = best.min(axis=0)
            busy = top < idle
            left = int(np.count_nonzero(busy))
            if left < 0.8 * n or not left:
                out[:, where[~busy]] = ids.compress(~busy, axis=1)
                ids, best, after, before, skips = (x.compress(busy, axis=1) for x in (ids, best, after, before, skips))
                where, last_skip, top, n = where[busy], last_skip[busy], top[busy], left
                tail = None if tail is None else tail[busy]
                busy = np.ones(n, bool)
                if not n:
                    break
            # All busy segments are at the same candidate: idle ones wait to be handed out.
            step += 1
            steps[where] += busy
            m = busy
            if any_skip:
                m = m & ~(skips == step).any(axis=0)
            if tail is not None:
                m = m & ~((step > last_skip) & (_draw(tail, step) <= np.uint64(self.under - 1)))
            at = (top & wide((1 << shift) - 1)).astype(np.int64)
            flat_ids, flat_best = ids.reshape(-1), best.reshape(-1)
            flat_after, flat_before = after.reshape(-1), before.reshape(-1)
            flat_best[at * n + np.arange(n)] = idle
            m = np.flatnonzero(m)
            one = at[m] * n + m
            whole = self.by_rank[top[m] >> shift]
            two = flat_after[one].astype(np.int64) * n + m
            third = flat_after[two]
            flat_ids[one], flat_ids[two], flat_after[one], flat_best[two] = whole, -1, third, idle
            has = np.flatnonzero(third < length)
            three = third[has].astype(np.int64) * n + m[has]
            flat_before[three] = at[m[has]]
            flat_best[one[has]] = self._pairs(whole[has], flat_ids[three]).astype(wide) << shift | at[m[has]].astype(wide)
            first = flat_before[one]
            has = np.flatnonzero(first >= 0)
            zero = first[has].astype(np.int64) * n + m[has]
            flat_best[zero] = self._pairs(flat_ids[zero], whole[has]).astype(wide) << shift | first[has].astype(wide)
        mask = out.T >= 0
        return out.T[mask], mask.sum(axis=1), steps

    def _forget(self) -> None:
        """Empty caches.  A node is a segment with given skips: its ids, its number of
        candidates, and whether it decodes to the segment."""
        self.segments: list[str] = []
        self.codes = _Ragged(np.uint32)
        self.alone = _Column(bool)          # segments that are merged one by one
        self.roots: dict[str, int] = {}
        self.after: dict[int, int] = {}     # node << 32 | place of its next skip
        self.found, self.steps, self.whole = _Ragged(np.int32), _Column(np.int32), _Column(bool)
        self.of = _Nodes(self.segments)

    def _note(self, segments: list[str]) -> np.ndarray:
        """Numbers of new segments."""
        first, sizes = len(self.segments), np.fromiter(map(len, segments), np.int64, len(segments))
        codes = _code_points(segments)
        alone = sizes > LONG
        if len(segments):
            alone |= np.logical_or.reduceat(self._characters(codes) < 0, np.cumsum(sizes) - sizes)
        if self.tied:
            alone |= np.fromiter((self.tied.search(s) is not None for s in segments), bool, len(segments))
        self.segments += segments
        self.codes.extend(codes, sizes)
        self.alone.extend(alone)
        return np.arange(first, len(self.segments))

    def _add(self, segment: np.ndarray, skips: np.ndarray, tails: np.ndarray | None = None) -> np.ndarray:
        """Append nodes of numbered segments; ``tails`` key the skips after the given ones.  Their numbers."""
        n, first = len(segment), len(self.found)
        self.of.segment.extend(segment)
        self.of.skips.extend(skips)
        sizes, steps, whole = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
        order, flats = [], []
        lengths = np.where(self.alone[segment], 0, self.codes.size[segment])
        by_length = np.argsort(lengths, kind="stable")
        for group in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
            for lo in range(0, len(group), CHUNK):
                k = group[lo:lo + CHUNK]
                order.append(k)
                tail = None if tails is None else tails[k]
                if lengths[k[0]] and len(k) >= 4:
                    codes = self.codes.take(segment[k]).reshape(len(k), -1)
                    flat, sizes[k], steps[k] = self._merge_many(codes, skips[k], tail)
                    whole[k] = self._tells(flat, sizes[k], codes)
                    flats.append(flat)
                    continue
                for i, j in enumerate(k.tolist()):
                    text, given = self.of[first + j]
                    ids, steps[j] = self._merge(text, given, None if tail is None else int(tail[i]))
                    sizes[j], whole[j] = len(ids), b"".join(map(self.text.__getitem__, ids)) == text.encode()
                    flats.append(np.array(ids, np.int32))
        if n:       # back from the order of lengths
            order, flat = np.concatenate(order), np.concatenate(flats)
            start = np.empty(n, np.int64)
            start[order] = np.cumsum(sizes[order]) - sizes[order]
            self.found.extend(flat[_spread(start, sizes)], sizes)
        self.steps.extend(steps)
        self.whole.extend(whole)
        return np.arange(first, first + n)

    def _tells(self, flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the pieces of each segment write its characters."""
        written = np.add.reduceat(self.piece_chars.size[flat], np.cumsum(sizes) - sizes)
        ok = written == codes.shape[1]
        flat = flat[np.repeat(ok, sizes)]
        ok[ok] = (self.piece_chars.take(flat).reshape(-1, codes.shape[1]) == codes[ok]).all(axis=1)
        return ok

    def _nodes(self, segments: list[str], keys: np.ndarray) -> np.ndarray:
        """Node of each segment at the place keyed by ``keys``."""
        if len(self.found) + len(segments) > self.cache_size:
            # About to outgrow the cache: only what is new counts.
            if len(self.found) + len(set(segments).difference(self.roots)) > self.cache_size:
                self._forget()
        new = list(set(segments).difference(self.roots))
        made = self._add(self._note(new), np.full((len(new), SKIPS + 1), -1, np.int32))
        self.roots.update(zip(new, made.tolist()))
        node = np.fromiter(map(self.roots.__getitem__, segments), np.int64, len(segments))
        if not self.under:
            return node
        at = np.arange(len(node))           # places whose segment may have a further skip
        last = np.full(len(node), -1)
        for k in range(SKIPS + 1):
            place = last[at] + 1 + _gap(_draw(keys[at], -1 - k), self.alpha)
            hit = place < self.steps[node[at]]
            at, place = at[hit], place[hit]
            if not len(at):
                break
            last[at] = place
            here = node[at]
            direct = self.codes.size[self.of.segment[here]] > LONG if k < SKIPS else np.ones(len(at), bool)
            node[at[direct]] = self._skip(here[direct], k, place[direct], keys[at[direct]])
            at, pair = at[~direct], here[~direct] << 32 | place[~direct]
            pair, which = np.unique(pair, return_inverse=True)
            known = np.fromiter(map(self.after.get, pair.tolist(), repeat(-1)), np.int64, len(pair))
            new = pair[known < 0]
            made = self._skip(new >> 32, k, new & 0xFFFFFFFF)
            self.after.update(zip(new.tolist(), made.tolist()))
            known[known < 0] = made
            node[at] = known[which]
        return node

    def _skip(self, nodes: np.ndarray, k: int, place: np.ndarray, tails: np.ndarray | None = None) -> np.ndarray:
        """Nodes that skip a further candidate, their ``k``-th."""
        skips = self.of.skips[nodes]
        skips[:, k] = place
        return self._add(self.of.segment[nodes], skips, tails)

    def segment_ids(self, segment: str, stream: int = 0) -> list[int]:
        """Ids of one segment; ``stream`` keys its dropout."""
        tail = int(_keys(_code_points([segment])[None, :], self.seed, stream)[0]) if self.under else None
        return self._merge(segment, (), tail)[0]

    def _merge(self, segment: str, skips, tail: int | None) -> tuple[list[int], int]:
        """Ids of one segment, and how many candidates it tried.

        Symbols sit at their first character.  The candidates numbered in
        ``skips`` are skipped for good, and, with a key ``tail``, each later one
        whose keyed hash is under alpha.
        """
        # A literal mark in the text is no space: its symbol matches no piece.
        symbols = [SPACE if c == " " else "\0" + c if c == SPACE else c for c in segment]
        n, cost, under, step = len(symbols), self.cost, self.under, -1
        last_skip = max(skips, default=-1)
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = [(c, k, k + 1, k + 2) for k in range(n - 1)
                      if (c := cost.get(symbols[k] + symbols[k + 1])) is not None]
            heapify(agenda)
            while agenda:
                _, left, mid, end = heappop(agenda)
                # Stale: a border has moved since the candidate was made.
                if symbols[left] is None or after[left] != mid or symbols[mid] is None or after[mid] != end:
                    continue
                step += 1
                if step in skips or tail is not None and step > last_skip and _draw_one(tail, step) < under:
                    continue
                whole = symbols[left] + symbols[mid]
                symbols[left], symbols[mid], after[left] = whole, None, end
                if end < n:
                    before[end] = left
                    if (c := cost.get(whole + symbols[end])) is not None:
                        heappush(agenda, (c, left, end, after[end]))
                b = before[left]
                if b >= 0 and (c := cost.get(symbols[b] + whole)) is not None:
                    heappush(agenda, (c, b, left, end))
        out = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                if i is None:
                    out += [self.byte_ids[x] for x in s.lstrip("\0").encode()] if s != "\0" else [self.byte_ids[0]]
                else:
                    out.append(i)
        return out, step + 1

    def encode_flat(self, texts: list[str], keys: list[int], chars: int = 3_000_000):
        """Ids of whole texts one behind the other, the number of each text's, and
        whether each decodes to its text; a text's key (of its document) and the
        place of a segment key its dropout.  A space is put before the text, as the
        model expects.  About ``chars`` characters are looked up at a time."""
        flats, counts, same, at = [np.zeros(0, np.int32)], [], [], 0
        start = mix64(np.array([(k ^ self.seed * 0x9E3779B97F4A7C15) & _M64 for k in keys], np.uint64))
        while at < len(texts):
            segments, sizes, size, first = [], [], 0, at
            while at < len(texts) and (at == first or size < chars):
                text = texts[at]
                size += len(text)
                own = _SEGMENT.findall(" " + text) if text else []
                segments += own
                sizes.append(len(own))
                at += 1
            sizes = np.array(sizes, np.int64)
            place = _spread(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64)
            with np.errstate(over="ignore"):
                place = np.repeat(start[first:at], sizes) + place * np.uint64(0xD1B54A32D192ED03)
            nodes = self._nodes(segments, mix64(place))
            flats.append(self.found.take(nodes))
            # A text is lossless if its segments are; else its tokens are decoded.
            begins = np.cumsum(sizes) - sizes
            of = lambda x: np.add.reduceat(np.append(x, 0), begins) * (sizes > 0)
            count, good = of(self.found.size[nodes]), of(self.whole[nodes].astype(np.int64)) == sizes
            good &= of(self.codes.size[self.of.segment[nodes]]) == [len(t) + (t != "") for t in texts[first:at]]
            for k in np.flatnonzero(~good).tolist():
                lo = int(count[:k].sum())
                good[k] = self.decode(flats[-1][lo:lo + count[k]].tolist()) == texts[first + k]
            counts.append(count)
            same.append(good)
        join = lambda x, dtype: np.concatenate(x) if x else np.zeros(0, dtype)
        return np.concatenate(flats), join(counts, np.int64), join(same, bool)

    def encode_all(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of whole texts, one array a text."""
        flat, counts, _ = self.encode_flat(texts, keys)
        return np.split(flat, np.cumsum(counts)[:-1]) if len(texts) else []

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str:
        """The text that was encoded, exactly."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8")


class _Nodes:
    """What each node stands for: item k is its segment and the candidates it skips."""

    def __init__(self, segments: list[str]):
        self.segments, self.segment, self.skips = segments, _Column(np.int64), _Column(np.int32, (SKIPS + 1,))

    def __getitem__(self, k: int) -> tuple[str, list[int]]:
        return self.segments[self.segment[k]], [x for x in self.skips[k].tolist() if x >= 0]


def _code_points(segments: list[str]) -> np.ndarray:
    return np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)


def _keys(codes: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Keyed 64-bit hash of each row of code points."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), (seed * 1_000_003 + stream) & _M64, np.uint64)
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix64(h)


def _draw(key: np.ndarray, step: int) -> np.ndarray:
    """Keyed 64-bit random number of a step."""
    with np.errstate(over="ignore"):
        return mix64(key + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & _M64))


def _draw_one(key: int, step: int) -> int:
    """``_draw`` of one key in plain integers."""
    h = (key + (step + 1) * 0x9E3779B97F4A7C15) & _M64
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & _M64
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & _M64
    return h ^ h >> 33


def _gap(h: np.ndarray, alpha: float) -> np.ndarray:
    """How many candidates pass before one is skipped: geometric with rate ``alpha``."""
    if alpha >= 1:
        return np.zeros(len(h), np.int64)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
    return np.minimum(np.log(u) / np.log1p(-alpha), 2.0 ** 40).astype(np.int64)


def tokenize(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, tokens, n_tokens, lossless), one per input row.

    ``lossless`` tells that decoding the tokens gives the whole text back; it is
    computed, not assumed.  A null text has null tokens, an empty text none; both
    are lossless.  The dropout of a row is keyed by its id, so repeated rows
    come out alike.  An empty table gives no rows; columns not in ``keep`` are ignored.
    """
    first = 1 + len(keep)       # columns that pass as they are; the text and its key come after

    def encoded(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(first).to_pylist()
        flat, counts, same = tokenizer.encode_flat([t or "" for t in texts], b.column(first + 1).to_pylist())
        ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        ids = pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array([t is None for t in texts], pa.bool_()))
        made = [ids, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays([*b.columns[:first], *made],
                                          names=[*b.schema.names[:first], "tokens", "n_tokens", "lossless"])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                yield encoded(b.slice(lo, SLICE))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c) for c in keep], F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    schema = T.StructType(rows.schema.fields[:first]).add("tokens", T.ArrayType(T.IntegerType())) \
        .add("n_tokens", T.LongType()).add("lossless", T.BooleanType())
    return rows.mapInArrow(run, schema)


def detokenize(rows: DataFrame, tokenizer: Tokenizer, tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of their tokens in place of them, exactly the one that
    ``tokenize`` was given.  Null tokens have the null text, no tokens the empty one;
    tokens that are no text in UTF-8 (cut in the middle of a character) or no pieces
    of the model have the null text too.  Rows stay one for one, other columns as
    they are; an empty table gives no rows."""
    at = rows.columns.index(tokens_col)

    def text_of(ids):
        try:
            if ids and min(ids) < 0:
                return None
            return None if ids is None else tokenizer.decode(ids) if ids else ""
        except (UnicodeDecodeError, IndexError, TypeError):
            return None

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                texts = pa.array([text_of(t) for t in part.column(at).to_pylist()], pa.string())
                yield part.set_column(at, text_col, texts)

    schema = T.StructType([T.StructField(text_col, T.StringType()) if k == at else f for k, f in enumerate(rows.schema.fields)])
    return rows.mapInArrow(run, schema)
