"""XOR coding of float32 sequences (Pelkonen et al., "Gorilla", VLDB 2015), bit layout:

first value: 32 bits; then per value `0` if equal to the previous one, `10` + the significant bits
when they fit the last stored window, else `11` + 5-bit leading zeros + 6-bit length + bits.
"""

import numpy as np


_FLUSH_BITS = 4096  # shifting one growing integer over a whole payload would be quadratic


def prepared(values: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The bits of all values, and for each after the first: XOR with the one before it, its leading and its trailing zeros."""
    bits = np.ascontiguousarray(values, dtype=np.float32).view(np.uint32)
    x = (bits[1:] ^ bits[:-1]).astype(np.int64)
    lead, trail = 32 - np.frexp(x)[1], np.frexp(x & -x)[1] - 1
    return bits.tolist(), list(zip(x.tolist(), lead.tolist(), trail.tolist()))


def encode(values: np.ndarray) -> bytes:
    bits, steps = prepared(values)
    return encoded(bits[0], steps)


def encoded(first: int, steps: list[tuple[int, int, int]]) -> bytes:
    """Code of a value and those that follow it, see prepared()."""
    done, acc, size = [], first, 32
    kept_lead, kept_trail = 33, 0
    for x, lead, trail in steps:
        if x == 0:
            acc, size = acc << 1, size + 1
        else:
            if lead >= kept_lead and trail >= kept_trail:
                n = 32 - kept_lead - kept_trail
                acc, size = acc << n + 2 | 0b10 << n | x >> kept_trail, size + n + 2
            else:
                kept_lead, kept_trail, n = lead, trail, 32 - lead - trail
                acc, size = acc << n + 13 | (0b11 << 11 | lead << 6 | n) << n | x >> trail, size + n + 13
        if size > _FLUSH_BITS:
            done.append(format(acc, f"0{size}b"))
            acc, size = 0, 0
    done.append(format(acc, f"0{size}b") if size else "")
    joined = "".join(done)
    joined += "0" * (-len(joined) % 8)
    return int(joined, 2).to_bytes(len(joined) // 8, "big")


def decode_many(payloads: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Values of all payloads, concatenated. All payloads advance together, one value per step."""
    counts = np.asarray(counts, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    result = np.zeros(int(starts[-1]), dtype=np.uint32)
    if not len(payloads):
        return result.view(np.float32)
    data = np.frombuffer(b"".join(payloads) + b"\0" * 8, dtype=np.uint8)
    sizes = np.fromiter((len(p) for p in payloads), dtype=np.int64, count=len(payloads))
    at = np.concatenate(([0], np.cumsum(sizes)[:-1])) * 8
    eight = np.arange(8)

    def read(rows, n):
        pos = at[rows]
        words = data[(pos >> 3)[:, None] + eight].copy().view(">u8").ravel().astype(np.uint64)
        n = np.broadcast_to(np.asarray(n, dtype=np.int64), rows.shape)
        shift = (64 - (pos & 7) - n).astype(np.uint64)
        at[rows] += n
        return (words >> shift) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))

    rows = np.flatnonzero(counts > 0)
    last = np.zeros(len(payloads), dtype=np.uint64)
    trail = np.zeros(len(payloads), dtype=np.int64)
    length = np.zeros(len(payloads), dtype=np.int64)
    last[rows] = read(rows, 32)
    result[starts[rows]] = last[rows]
    for i in range(1, int(counts.max(initial=0))):
        rows = rows[counts[rows] > i]
        changed = rows[read(rows, 1) == 1]
        fresh = changed[read(changed, 1) == 1]
        lead = read(fresh, 5).astype(np.int64)
        length[fresh] = read(fresh, 6)
        trail[fresh] = 32 - length[fresh] - lead
        last[changed] ^= read(changed, length[changed]) << trail[changed].astype(np.uint64)
        result[starts[rows] + i] = last[rows]
    return result.view(np.float32)
