"""Words, weighted shingles and their consistent samples, many texts at a time in numpy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_CHUNK = 1 << 19
#: What ``str.split`` takes for white space (fixed values).
_SPACES = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[list(_SPACES)] = True
_SPACE = re.compile(r"\s")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of an odd number modulo 2^64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.held = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            out = np.full(max(n, 1 << 16), self.base)
            out[0] = 1
            self.held = np.multiply.accumulate(out)
        return self.held[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(pow(_BASE, -1, 2**64))


def _chunks(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """(lower-case parts, their texts' numbers) of about ``_CHUNK`` characters; a longer text is cut behind words."""
    parts, owners, size = [], [], 0
    for k, text in enumerate(texts):
        low, at = text.lower(), 0
        while True:
            end = len(low)
            if end - at > _CHUNK and (cut := _SPACE.search(low, at + _CHUNK)):
                end = cut.end()
            parts.append(low[at:end])
            owners.append(k)
            size += end - at
            at = end
            if size >= _CHUNK:
                yield parts, owners
                parts, owners, size = [], [], 0
            if at >= len(low):
                break
    if parts:
        yield parts, owners


def word_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words in a row, and where each text's begin; words are what white space separates.

    A word's hash is a polynomial of its characters, read off running sums over the characters of many texts.
    """
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for parts, owners in _chunks(texts):
        codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        space = _IS_SPACE[np.minimum(codes, 0x3001)]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        value = codes.astype(np.uint64)
        value += np.uint64(1)
        value *= _MIX
        value ^= value >> np.uint64(31)
        value *= _UP.upto(len(value))
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        found.append(mixed((sums[ends] - sums[starts]) * _DOWN.upto(len(value))[starts]))
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        np.add.at(counts, owners, np.diff(np.searchsorted(starts, bounds)))
    return np.concatenate(found), np.cumsum(np.concatenate(([0], counts)))


def distinct_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words by hash, in how many of the texts each is)."""
    hashes, ends = word_lines(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    new[1:] |= owner[1:] != owner[:-1]
    return hashes[first], np.add.reduceat(new.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


class Weights:
    """Inverse document frequency 1 + ln(n / df) of words; ``frequent`` has those below the ceiling, by the word's hash."""

    def __init__(self, frequent: dict[int, float], ceiling: float):
        self.ceiling, self.tables = ceiling, []
        keys = np.array(sorted(frequent), np.uint64)
        values = np.array([frequent[int(k)] for k in keys])
        odd = 0x9E3779B97F4A7C15
        while len(keys):  # a word whose slot is taken goes to the next table
            slots = self._slots(keys, np.uint64(odd))
            _, first = np.unique(slots, return_index=True)
            held, own = np.zeros(1 << 18, np.uint64), np.full(1 << 18, ceiling)
            held[slots[first]], own[slots[first]] = keys[first], values[first]
            self.tables.append((np.uint64(odd), held, own))
            keys, values, odd = np.delete(keys, first), np.delete(values, first), (odd * 5 + 2) % 2**64 | 1

    @staticmethod
    def _slots(hashes: np.ndarray, odd: np.uint64) -> np.ndarray:
        return (hashes * odd) >> np.uint64(46)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.ceiling)
        for odd, held, own in self.tables:
            slots = self._slots(hashes, odd)
            hit = np.flatnonzero(held[slots] == hashes)
            out[hit] = own[slots[hit]]
        return out


#: Distinct shingles of a text in order of their hash, their TF-IDF weights and their counts.
Shingles = tuple[np.ndarray, np.ndarray, np.ndarray]


def weighted_shingles(hashes: np.ndarray, ends: np.ndarray, weights: Weights, width: int) -> list[Shingles]:
    """The shingles of each line of words; a line shorter than ``width`` words is one shingle."""
    own, lines = weights.of(hashes), len(ends) - 1
    sizes = np.diff(ends)
    keys, idfs, owners = [], [], []
    for n in sorted({min(width, s) for s in np.unique(sizes[sizes > 0]).tolist()}):
        count = len(hashes) - n + 1
        owner = np.repeat(np.arange(lines), sizes)[:count]
        at = np.flatnonzero((np.arange(count) + n <= ends[owner + 1]) & (np.minimum(sizes[owner], width) == n))
        key, idf = np.zeros(len(at), np.uint64), np.zeros(len(at))
        for k in range(n):
            key = mixed(key ^ hashes[at + k]) + np.uint64(k)
            idf += own[at + k]
        keys.append(key)
        idfs.append(idf / n)
        owners.append(owner[at])
    if not keys:
        return [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))] * lines
    key, idf, owner = np.concatenate(keys), np.concatenate(idfs), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, idf, owner = key[order], idf[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key))).astype(float)
    key, weight = key[first], times * idf[first]
    at = np.searchsorted(owner[first], np.arange(lines + 1))
    return [(key[a:b], weight[a:b], times[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def shingles_of(texts: list[str], weights: Weights, width: int) -> list[Shingles]:
    return weighted_shingles(*word_lines(texts), weights, width)


def weighted_jaccard(a: Shingles, b: Shingles) -> float:
    """Weighted Jaccard similarity of two texts' shingles: by TF-IDF or by counts alone, whichever is higher.

    So a pair of similarity 0.8 in plain shingles is linked however rare the words are in which it differs.
    """
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    shared = a[0][at] == b[0]
    out = 0.0
    for wa, wb in zip(a[1:], b[1:], strict=True):
        low = np.minimum(wa[at[shared]], wb[shared]).sum()
        out = max(out, float(low / (wa.sum() + wb.sum() - low)))
    return out


class Sampler:
    """``n`` consistent samples of a text's shingles: by weight or by count.

    By weight, improved consistent weighted sampling: a shingle's random draws come from tables by bits of its hash, 32 bits wide,
    so that one pass over (samples, shingles) stays in vector registers; equal minima go to the least shingle.
    By count, fast similarity sketching: in each round a hash deals every occurrence to a sample, the least one stays, and rounds
    end when all samples have one; the share of equal samples estimates the similarity no worse than ``n`` independent minima.
    """

    def __init__(self, n: int, seed: int = 20_240_601):
        quantile = lambda bits: np.array([_gamma2_quantile((k + 0.5) / (1 << bits)) for k in range(1 << bits)])
        self.n, self.r, self.log_c = n, quantile(12).astype(np.float32), np.log(quantile(16)).astype(np.float32)
        salt, first, second = np.random.default_rng(seed).integers(0, 2**32, (3, n, 1), np.uint32)
        self.salt, self.first, self.second = salt, first | np.uint32(1), second | np.uint32(1)

    def sample(self, shingles: np.ndarray, weight: np.ndarray, block: int = 2048) -> np.ndarray:
        """The chosen (shingle, level) of each sample as a 64-bit hash."""
        best = None
        for at in range(0, len(shingles), block):
            own = self._block(shingles[at : at + block], weight[at : at + block])
            best = own if best is None else [np.where(own[0] < best[0], x, y) for x, y in zip(own, best, strict=True)]
        return best[1] + best[2] * _MIX

    def _block(self, shingles: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        log_w = np.log(weight).astype(np.float32)
        low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        a = low ^ self.salt
        a *= self.first
        b = a >> np.uint32(15)
        a ^= b
        a *= np.uint32(0x85EBCA6B)
        np.right_shift(a, np.uint32(13), out=b)
        a ^= b
        np.add(high, a, out=b)
        b *= self.second
        b >>= np.uint32(16)
        cost = self.log_c.take(b, mode="clip")
        np.right_shift(a, np.uint32(20), out=b)
        r = self.r.take(b, mode="clip")
        a &= np.uint32(0xFFFFF)
        beta = a.astype(np.float32)
        beta *= np.float32(2**-20)
        level = log_w / r
        level += beta
        np.floor(level, out=level)
        beta -= np.float32(1)
        height = level - beta
        height *= r
        cost -= height
        at = cost.argmin(1)
        rows = np.arange(len(at))
        return [cost[rows, at], shingles[at], level[rows, at].astype(np.int64).astype(np.uint64)]

    def sample_counts(self, sets: list[Shingles]) -> np.ndarray:
        """(texts, samples): the chosen occurrence of each sample, as a 64-bit hash; one of t times is t items, all alike likely."""
        sizes = [len(s[0]) for s in sets]
        out = np.zeros(len(sets) * self.n, np.uint64)
        if not sum(sizes):
            return out.reshape(len(sets), self.n)
        items, times = np.concatenate([s[0] for s in sets]), np.concatenate([s[2] for s in sets]).astype(np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        items, owner = np.repeat(items, times), np.repeat(owner, times)
        items = np.where(again > 0, mixed(items + again.astype(np.uint64) * _MIX), items)
        free = np.repeat(np.array(sizes) > 0, self.n)
        for turn in range(2 * self.n):
            value = mixed(items ^ np.uint64((turn + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
            dealt = ((value >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32) if turn < self.n else np.full(len(items), turn - self.n, np.uint64)
            slot = owner * self.n + dealt.astype(np.int64)
            value = (value << np.uint64(32)) | (value >> np.uint64(32))
            least = np.full(len(out), np.uint64(2**64 - 1))
            np.minimum.at(least, slot, value)
            won = free[slot] & (least[slot] == value)
            out[slot[won]] = items[won]
            free[slot[won]] = False
            unfinished = free.reshape(-1, self.n).any(1)
            if not unfinished.any():
                break
            here = unfinished[owner]
            items, owner = items[here], owner[here]
        return out.reshape(len(sets), self.n)


def _gamma2_quantile(u: float) -> float:
    """Quantile of Gamma(2, 1): the x with 1 - (1 + x) exp(-x) = u, by bisection."""
    low, high = 0.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - (1 + mid) * math.exp(-mid) < u else (low, mid)
    return (low + high) / 2
