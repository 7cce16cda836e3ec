"""Elias-Fano sequences and the n-gram trie made of them, over flat buffers that can be memory-mapped."""

from __future__ import annotations

import numpy as np

U = np.uint64


class EliasFano:
    """A rising sequence: low bits packed, high bits in unary with running popcounts beside them."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.l = int(parts["meta"][0]), int(parts["meta"][1])
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(x: np.ndarray) -> dict[str, np.ndarray]:
        x = np.asarray(x, np.int64)
        n = len(x)
        top = int(x[-1]) + 1 if n else 1
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.empty((n, l), np.uint8)
        for k in range(l):
            bits[:, k] = (x >> k) & 1
        low = np.append(np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8))
        size = n + (top >> l) + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[(x >> l) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(U)
        return {"meta": np.array([n, l], np.int64), "low": low, "high": high, "ones": np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int64)}

    def _pick(self, word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit of each word."""
        at = np.zeros(len(word), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
            go = r >= c
            r, at, word = r - c * go, at + width * go, word >> (go.astype(U) * U(width))
        return at

    def select(self, i: np.ndarray, one: bool) -> np.ndarray:
        count = self.ones if one else self.zeros
        w = np.searchsorted(count, i, "right") - 1
        return w * 64 + self._pick(self.high[w] if one else ~self.high[w], i - count[w])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.int64)
        bit = i * self.l
        raw = np.ascontiguousarray(self.low[(bit >> 3)[:, None] + np.arange(8)]).view("<u8").ravel()
        return ((raw >> (bit & 7).astype(U)) & U((1 << self.l) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i, True) - i) << self.l) | self.lows(i)

    def successor(self, v: np.ndarray) -> np.ndarray:
        """Index of the first element >= v, n if there is none."""
        h = np.minimum(v >> self.l, len(self.high) * 64 - self.n - 1)
        over = v >> self.l > h
        lo = np.where(h > 0, self.select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        hi = self.select(h, False) - h
        want = v & ((1 << self.l) - 1)
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.lows(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        return np.where(over, self.n, lo)


class Level:
    """Children of the nodes above: `first[k]` is the first child of node k; children rise within a node.

    Each node's children are stored on top of the last value of the node before, which makes the whole
    level one rising sequence: a child is found by a successor search relative to its node.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.first = EliasFano({k[2:]: v for k, v in parts.items() if k.startswith("f_")})
        self.child = EliasFano({k[2:]: v for k, v in parts.items() if k.startswith("c_")})
        self.codes, (self.low, self.step) = parts["codes"], parts["range"]

    @staticmethod
    def encode(node: np.ndarray, nodes: int, child: np.ndarray, logs: np.ndarray, bits: int = 16) -> dict[str, np.ndarray]:
        """node (rising) and child ids per entry; logs are quantised to 2^bits even steps, bits at most 16."""
        first = np.searchsorted(node, np.arange(nodes + 1))
        last = np.zeros(nodes, np.int64)
        full = first[1:] > first[:-1]
        last[full] = child[first[1:][full] - 1] + 1
        base = np.concatenate([[0], np.cumsum(last)])[:-1]
        lo, hi = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        step = (hi - lo) / ((1 << bits) - 1) if hi > lo else 1.0
        codes = np.rint((logs - lo) / step).astype(np.uint16)
        out = {f"f_{k}": v for k, v in EliasFano.encode(first).items()}
        out |= {f"c_{k}": v for k, v in EliasFano.encode(base[node] + child if len(node) else child).items()}
        return out | {"codes": codes, "range": np.array([lo, step])}

    def find(self, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Entry of each (node, child), -1 where the node is -1 or has no such child."""
        out = np.full(len(node), -1, np.int64)
        ask = np.flatnonzero(node >= 0)
        if not len(ask) or not self.child.n:
            return out
        lo, hi = self.first.access(node[ask]), self.first.access(node[ask] + 1)
        have = hi > lo
        ask, lo, hi = ask[have], lo[have], hi[have]
        base = np.where(lo > 0, self.child.access(np.maximum(lo - 1, 0)) + 1, 0)
        value = base + child[ask]
        at = self.child.successor(value)
        ok = (at >= lo) & (at < hi)
        ok[ok] = self.child.access(at[ok]) == value[ok]
        out[ask[ok]] = at[ok]
        return out

    def log(self, entry: np.ndarray) -> np.ndarray:
        """Quantised value of each entry; 0 where there is none."""
        return np.where(entry >= 0, self.low + self.step * self.codes[np.maximum(entry, 0)] if len(self.codes) else 0.0, 0.0)


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """One buffer: a directory of names, types and places, then the arrays, each at a multiple of 8."""
    import json

    at, where, body = 0, {}, []
    for k, v in parts.items():
        raw = np.ascontiguousarray(v).tobytes()
        where[k] = (v.dtype.str, at, len(v))
        body += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + (-len(raw) % 8)
    head = json.dumps(where).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def unpack(buffer) -> dict[str, np.ndarray]:
    """Views of the arrays in a buffer, or in a file mapped into memory; nothing is copied."""
    import json

    size = int.from_bytes(bytes(buffer[:8]), "little")
    where = json.loads(bytes(buffer[8 : 8 + size]))
    return {k: np.frombuffer(buffer, t, n, 8 + size + at) for k, (t, at, n) in where.items()}
