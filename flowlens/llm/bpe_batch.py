"""The backtracking encoder over many short pieces at once, in numpy.

All pieces take their steps together. An Aho-Corasick automaton over the reversed tokens reads every piece
from its end, so that the state after a symbol names the longest token that starts there. Then each piece
tries its longest token, the next shorter one, or takes the last one back, as ``WordBPE.encode_piece`` does
for one piece; dead places are marked in one array over all pieces. Whether two tokens may stand side by
side is computed for many pairs together and kept in a direct-mapped table that holds the pair itself, so
an entry that another one displaced is computed again and never mistaken.
"""

from __future__ import annotations

import numpy as np

from flowlens.llm import textbytes as tb

SYMBOLS = 512  # a byte, or a byte that ends a piece
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.int64(-1)


class Lookup:
    """A fixed table from non-negative integers to integers, open addressing with steps of one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _FREE)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            empty = self.keys[slot] == _FREE
            self.keys[slot[empty]] = keys[left[empty]]  # of several keys for one slot, one stays
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held != _FREE))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.values[at[same]]
            more = ~same & (held != _FREE)
            left, at = left[more], at[more]
        return out


class Batch:
    """Tables of a vocabulary: ``spelled`` names the token of each symbol string, the rest is indexed by token."""

    def __init__(self, spelled: dict[str, int], pairs: dict[tuple[int, int], int], rank: list[int], left: list[int], right: list[int], length: list[int], shorter: list[int]):
        self.rank, self.left, self.right, self.shorter = (np.array(x, dtype=np.int32) for x in (rank, left, right, shorter))
        self.length = np.array([*length, 0])  # the last entry is that of no token (-1)
        self.size, self.merges = np.int64(len(rank)), len(pairs)
        both = np.array(list(pairs), dtype=np.int64).reshape(-1, 2)
        self.pairs = Lookup(both[:, 0] * self.size + both[:, 1], np.array(list(pairs.values()), dtype=np.int32))
        self.bits = 20
        self.known = np.full(1 << self.bits, _FREE)  # pair * 2 + whether it fits
        self._automaton(spelled)

    def _automaton(self, spelled: dict[str, int]) -> None:
        children: dict[int, int] = {}
        token, above, symbol, depth = [-1], [0], [0], [0]
        for text, i in spelled.items():
            node = 0
            for c in map(ord, reversed(text)):
                key = node * SYMBOLS + c
                below = children.get(key)
                if below is None:
                    below = children[key] = len(token)
                    token.append(-1)
                    above.append(node)
                    symbol.append(c)
                    depth.append(depth[node] + 1)
                node = below
            token[node] = i
        self.next = Lookup(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children)))
        self.token, self.fail = np.array(token, dtype=np.int32), np.zeros(len(token), dtype=np.int32)
        above, symbol, depth = np.array(above), np.array(symbol), np.array(depth)
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
        for d in range(1, int(depth.max()) + 1):  # failure links, one depth after the other
            nodes = by_depth[edges[d] : edges[d + 1]]
            if d > 1:
                self.fail[nodes] = self._advance(self.fail[above[nodes]], symbol[nodes])
            self.token[nodes] = np.where(self.token[nodes] >= 0, self.token[nodes], self.token[self.fail[nodes]])

    def _advance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States after a symbol: the child, or that of the nearest failure link that has one, or the root."""
        out = np.zeros(len(state), dtype=np.int32)
        left = np.arange(len(state))
        while len(left):
            below = self.next.find(state.astype(np.int64) * SYMBOLS + symbol)
            found = below >= 0
            out[left[found]] = below[found]
            more = ~found & (state != 0)
            left, state, symbol = left[more], self.fail[state[more]], symbol[more]
        return out

    def _longest(self, symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The longest token from each place; pieces come in the order of their sizes, the largest first."""
        out = np.empty(len(symbols), dtype=np.int32)
        state = np.zeros(len(sizes), dtype=np.int32)
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
        for back, n in enumerate(live.tolist()):
            at = ends[:n] - 1 - back
            state[:n] = self._advance(state[:n], symbols[at])
            out[at] = self.token[state[:n]]
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves the boundary between tokens a and b: ``WordBPE._fits`` for many pairs."""
        out, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        limit, left_first = np.full(len(a), self.merges), np.zeros(len(a), dtype=bool)
        while len(live):
            across = self.pairs.find(a.astype(np.int64) * self.size + b)
            broken = (across >= 0) & ((across < limit) | (across == limit) & left_first)
            out[live[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            more = ~broken & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[more], a[more], b[more], ra[more], rb[more]
            of_left = ra > rb
            limit, left_first = np.where(of_left, ra, rb), ~of_left
            a, b = np.where(of_left, self.right[a], a), np.where(of_left, b, self.left[b])
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) * self.size + b
        slot = ((pair.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.known[slot]
        out = (held & 1) == 1
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            distinct, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            first = new[first]
            answer = self._undo(a[first], b[first])
            self.known[slot[first]] = distinct * 2 + answer
            out[new] = answer[back]
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece (at least one character), as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-sizes, kind="stable")
        raw, sizes = [raw[i] for i in order.tolist()], sizes[order]
        symbols = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbols[ends - 1] += 256
        longest = self._longest(symbols, ends, sizes)
        start = ends - sizes
        count = np.zeros(len(raw), dtype=np.int64)
        stack = np.empty(len(symbols), dtype=np.int32)  # a piece's tokens stand from its first place on
        dead = np.zeros(len(symbols) + 1, dtype=bool)
        live, at, top, token = np.arange(len(raw)), start.copy(), start.copy(), longest[start]
        first, end = start, ends
        while len(live):
            some = token >= 0
            good = some & ~dead[at + self.length[token]]
            check = np.flatnonzero(good & (top > first))
            good[check] = self.fits(stack[top[check] - 1], token[check])
            back = np.flatnonzero(~some)
            dead[at[back]] = True
            shorten = np.flatnonzero(some & ~good)
            token[shorten] = self.shorter[token[shorten]]
            push = np.flatnonzero(good)
            stack[top[push]] = token[push]
            at[push] += self.length[token[push]]
            top[push] += 1
            token[push] = longest[np.minimum(at[push], len(longest) - 1)]
            top[back] -= 1
            taken = stack[top[back]]
            at[back] -= self.length[taken]
            token[back] = self.shorter[taken]
            done = at == end
            if done.any():
                count[live[done]] = (top - first)[done]
                left = ~done
                live, at, top, token, first, end = live[left], at[left], top[left], token[left], first[left], end[left]
        ids = stack[tb.ranges(start, count)].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(count)).tolist()]
        out = [b""] * len(raw)
        for i, place in enumerate(order.tolist()):
            out[place] = ids[cuts[i] : cuts[i + 1]]
        return out
