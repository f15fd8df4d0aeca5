"""CRC-32 of many spans of one buffer at once, by a table of positions.

A CRC is linear over XOR: the CRC of a span is a constant of its length XOR what each byte contributes, and a contribution depends on
the byte and its distance from the end of the span only. Contributions are looked up and XORed over spans by reduceat. A
span longer than BLOCK is cut into blocks from its end; values of neighbouring blocks are folded pairwise, the left one moved on by the
bytes of the right one, so a span of n blocks takes log2(n) folds.
"""

import numpy as np

from tidegauge.llm import text as T

# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
BLOCK = 64
SPANS = 1 << 15


def byte_table() -> np.ndarray:
    """What one byte leaves in a register of zeros."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


def after_zero(register: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Registers after one more byte of zero."""
    return (register >> np.uint32(8)) ^ table[register & np.uint32(255)]


def applied(shift: np.ndarray, register: np.ndarray) -> np.ndarray:
    """A linear map, given by its values on the four bytes of a register."""
    out = shift[0][register & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ shift[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class PositionTable:
    def __init__(self):
        table = byte_table()
        rows = [table]
        for _ in range(BLOCK - 1):
            rows.append(after_zero(rows[-1], table))
        self.contributions = np.concatenate(rows)  # [distance from the end * 256 + byte]
        shift = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(BLOCK):
            shift = after_zero(shift, table)
        self.shifts = [shift]  # of BLOCK * 2**k bytes of zero
        constant = np.uint32(0xFFFFFFFF)
        constants = []
        for _ in range(BLOCK):
            constants.append(constant)
            constant = after_zero(constant, table)
        self.constants = np.array(constants, np.uint32)  # the register of ones after so many bytes of zero

    def shift(self, k: int) -> np.ndarray:
        while len(self.shifts) <= k:
            self.shifts.append(applied(self.shifts[-1], self.shifts[-1]))
        return self.shifts[k]

    def length_constants(self, lengths: np.ndarray) -> np.ndarray:
        out = self.constants[lengths % BLOCK]
        blocks, k = lengths // BLOCK, 0
        while (blocks >> k).any():
            out = np.where((blocks >> k) & 1, applied(self.shift(k), out), out)
            k += 1
        return out ^ np.uint32(0xFFFFFFFF)

    def xor_spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Contributions of spans of 1 to BLOCK bytes, XORed; a bounded number of bytes at a time."""
        out = np.zeros(len(start), np.uint32)
        for a in range(0, len(start), SPANS):
            first, last = start[a:a + SPANS], end[a:a + SPANS]
            lengths = last - first
            heads = np.cumsum(lengths) - lengths
            at = np.arange(int(lengths.sum())) + np.repeat(first - heads, lengths)
            distance = np.repeat(last - 1, lengths) - at
            out[a:a + SPANS] = np.bitwise_xor.reduceat(self.contributions[distance * 256 + data[at]], heads)
        return out

    def crc32(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of data[start[i]:end[i]] for every i, as uint32; spans may overlap and be empty."""
        lengths = end - start
        out = np.zeros(len(start), np.uint32)
        short, long = np.flatnonzero((lengths > 0) & (lengths <= BLOCK)), np.flatnonzero(lengths > BLOCK)
        out[short] = self.xor_spans(data, start[short], end[short])
        out[long] = self.folded(data, start[long], end[long])
        return out ^ self.length_constants(lengths)

    def folded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Contributions of long spans, all folded together; blocks count from the end of their span."""
        blocks = -(-(end - start) // BLOCK)
        block = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        stop = np.repeat(end, blocks) - block * BLOCK
        values = self.xor_spans(data, np.maximum(np.repeat(start, blocks), stop - BLOCK), stop)
        k = 0
        while len(values) > len(start):
            values = np.where(block & 1, applied(self.shift(k), values), values)
            heads = np.flatnonzero(block % 2 == 0)
            values, block, k = np.bitwise_xor.reduceat(values, heads), block[heads] // 2, k + 1
        return values


def position_table() -> PositionTable:
    return T.worker_memo("crc positions", PositionTable)


def crc_sql(words: str) -> str:
    """DuckDB clauses that end in crcs(word, crc), from a SELECT of distinct words."""
    return f"""crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) AS v FROM range(256) r(i))),
 crc_words AS ({words}),
 crcs AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || hex(word)[2 * k - 1:2 * k] AS BIGINT) FOR k IN range(1, strlen(word) + 1)]),
   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM crc_words, crc_table WHERE word IS NOT NULL)"""
