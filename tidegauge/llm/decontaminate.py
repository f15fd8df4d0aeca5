"""Documents that hold benchmark items, also with other numbers, names or units, by joined template windows.

Words lose punctuation at both ends and case. In a template, numbers, names (capitalised words within a sentence) and units after
a number become typed placeholders. All windows of WINDOW template words of the items, and the same windows as plain words, are
hashed; documents are scanned for them through a bit filter of bounded size and joined by hash. An item shorter than a window
is a window of its own length; one below SHORTEST words can't be told from chance inside a text and matches documents that
consist of the same words only. Neighbouring names, or
numbers with their unit, are also folded into one placeholder, and windows with such a one are hashed too: "Peter" and "Peter
Smith", "12" and "1 200", "5 km" and "5km" agree. Windows with fewer than half plain words would match any table of numbers: they
count only beside others, and those without a plain word never.

Matches of one document and item on one diagonal are then checked together: their placeholders must be of equal types, and equal
values in the item must be equal in the document and unequal ones unequal, so a question with other numbers and names
counts and one that mixes them up does not. Around each such piece, the larger ones first, others within NEAR times the item's
words are joined that keep the order of words and the renaming; one that contradicts is left out. A match counts if its pieces
cover SHARE of the item's words.

Cases: null or short texts match nothing; rows without id match nothing; an empty benchmark matches nothing. Documents that
share an id are one document whose windows are told apart by text. The filter is at most FILTER_BITS; a benchmark beyond
it only sends more windows to the join.
"""

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import text as T
from tidegauge.llm.jaccard import runs_of

WINDOW = 8
SHORTEST = 4
SHARE = 0.5
NEAR = 2
FILTER_BITS = 1 << 26
FILTER_PARTS = 1 << 9
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
# Units that follow a number, and signs that end a sentence.
UNITS = """% mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams
kilogram kilograms pound pounds ton tons l ml cl liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years mph kmh km/h m/s v w kw kwh a ohm hz khz mhz ghz gb mb kb tb usd eur dollar dollars euro euros
cent cents degree degrees c f k percent""".split()
STOPS = b".!?:;|"


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(T.span_hashes(T.rolling(data), np.array([0]), np.array([len(data)]))[0])


UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() and chr(b) not in "%" for b in range(256)])
DIGIT = np.array([chr(b).isdigit() if b < 0x80 else False for b in range(256)])
STOP = np.isin(np.arange(256), np.frombuffer(STOPS, np.uint8))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, type and hash of the plain form of every word."""
    start, end = T.spans(data, offsets, T.IS_SPACE[data])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    at = np.arange(len(data))
    inner = ~PUNCTUATION[data]
    previous = np.maximum.accumulate(np.where(inner, at, -1))
    following = np.minimum.accumulate(np.where(inner, at, len(data))[::-1])[::-1]
    low, high = following[start], previous[end - 1] + 1
    keep = low < np.minimum(high, end)
    # a sentence begins after a stop, a line break or the start of the row
    breaks = np.append(0, np.cumsum(data == 0x0A))
    stopped = STOP[data[end - 1]]
    begins = np.ones(len(start), bool)
    begins[1:] = (row[1:] != row[:-1]) | stopped[:-1] | (breaks[start[1:]] > breaks[end[:-1]])
    row, low, high, begins = row[keep], low[keep], high[keep], begins[keep]
    lowered = T.LOWER[data]
    plain = T.span_hashes(T.rolling(lowered), low, high)
    first, second = data[low], data[np.minimum(low + 1, len(data) - 1)]
    two = high - low >= 2
    capital = ((first >= 65) & (first <= 90) & ((high - low == 1) | (second >= 97))) | (two & (first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kind = np.where(capital & ~begins, NAME, PLAIN).astype(np.int8)
    kind[DIGIT[first]] = NUMBER
    unit = np.isin(plain, UNIT_HASHES)
    unit[1:] &= (kind[:-1] == NUMBER) & (row[1:] == row[:-1])
    unit[:1] = False
    kind[unit & (kind != NUMBER)] = UNIT
    return row, kind, plain


def template(kind: np.ndarray, plain: np.ndarray) -> np.ndarray:
    return np.where(kind == PLAIN, plain, T.mix(kind.astype(np.uint64) + np.uint64(1)))


def folded(row: np.ndarray, kind: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, type and hash of every word where runs of names, or of numbers and their unit, are one; its first word and number of words."""
    if not len(row):
        return row, kind, plain, np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = np.zeros(len(row), bool)
    before, after = kind[:-1], kind[1:]
    inner[1:] = (row[1:] == row[:-1]) & (((before == after) & ((after == NAME) | (after == NUMBER))) | ((before == NUMBER) & (after == UNIT)))
    first = np.flatnonzero(~inner)
    sizes = np.diff(np.append(first, len(row)))
    step = np.arange(len(row)) - np.repeat(first, sizes)
    joined = T.mix(np.add.reduceat(T.mix(plain + step.astype(np.uint64)), first))
    return row[first], kind[first], np.where(sizes == 1, plain[first], joined), first, sizes


def window_keys(row: np.ndarray, kind: np.ndarray, plain: np.ndarray, length: int, sizes: np.ndarray | None = None):
    """First words and hashes of all windows, and which have few plain words: template windows, and plain windows where that differs.

    Of folded words, which have sizes, only template windows with a fold.
    """
    n = len(row) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    whole = row[:n] == row[length - 1:]
    slots = np.append(0, np.cumsum(kind != PLAIN))
    filled = slots[length:] - slots[:-length]
    salt = np.uint64(length)
    if sizes is not None:
        folds = np.append(0, np.cumsum(sizes > 1))
        whole &= folds[length:] > folds[:-length]
    as_template = np.flatnonzero(whole & (filled < length))
    keys = T.mix(T.windows(template(kind, plain), length)[as_template] + salt)
    few = 2 * filled[as_template] > length
    if sizes is not None:
        return as_template, keys, few
    as_plain = np.flatnonzero(whole & (filled > 0))
    return (np.concatenate([as_template, as_plain]), np.concatenate([keys, T.mix(T.windows(plain, length)[as_plain] + salt)]),
            np.concatenate([few, np.zeros(len(as_plain), bool)]))


def whole_keys(row: np.ndarray, plain: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the rows that have n words and no more."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    first = first[np.diff(np.append(first, len(row))) == n]
    return first, T.mix(T.windows(plain, n)[first] ^ np.uint64(n)) if len(first) else np.zeros(0, np.uint64)


ITEMS_DDL = "item_id bigint, item_key bigint, key bigint, at bigint, words bigint, length int, kinds binary, plain binary, sizes binary"


def _item_windows(batches):
    for batch in batches:
        ids, item_keys = batch.column("item_id").to_pylist(), batch.column("item_key").to_pylist()
        out = []
        for a, b, data, offsets in T.text_pieces(batch.column("text")):
            row, kind, plain = canonical(data, offsets)
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            for k, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
                if ids[a + k] is None:
                    continue
                own, short = (row[x:y], kind[x:y], plain[x:y]), int(y - x)
                if 0 < short < SHORTEST:
                    _, keys = whole_keys(row[x:y], plain[x:y], short)
                    out.append((ids[a + k], item_keys[a + k], int(keys.view(np.int64)[0]), 0, short, -short, kind[x:y].tobytes(), plain[x:y].tobytes(), b""))
                    continue
                for rows, kinds, plains, first, sizes in ((*own, np.arange(y - x), None), folded(*own)):
                    length = min(WINDOW, len(rows))
                    if length < SHORTEST:
                        continue
                    at, keys, _ = window_keys(rows, kinds, plains, length, sizes)
                    out += [(ids[a + k], item_keys[a + k], int(key.view(np.int64)), int(first[i]), int(y - x), length, kinds[i:i + length].tobytes(), plains[i:i + length].tobytes(),
                             b"" if sizes is None else sizes[i:i + length].astype(np.int32).tobytes()) for i, key in zip(at, keys)]
        columns = list(zip(*out)) or [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "item_key", "key", "at", "words", "length", "kinds", "plain", "sizes"])


def _bits_of(bits: int):
    def run(table: pa.Table) -> pa.Table:
        flags = np.zeros(bits // FILTER_PARTS, bool)
        flags[table["bit"].to_numpy()] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "flags": T.binary([np.packbits(flags).tobytes()])})
    return run


def bit_filter(windows: DataFrame) -> np.ndarray:
    """Flags of the keys' low bits: 64 bits a window, from 2**16 to FILTER_BITS; at most FILTER_BITS / 8 bytes reach the driver."""
    n = windows.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (64 * max(1, n) - 1).bit_length()))
    low = F.col("key").bitwiseAND(bits - 1)
    width = bits // FILTER_PARTS
    parts = windows.select(F.floor(low / width).alias("part"), (low % width).alias("bit")).distinct()
    flags = np.zeros((FILTER_PARTS, width // 8), np.uint8)
    for r in parts.groupBy("part").applyInArrow(_bits_of(bits), "part bigint, flags binary").collect():
        flags[r.part] = np.frombuffer(r.flags, np.uint8)
    return np.unpackbits(flags.ravel()).view(bool) if bits <= 1 << 20 else flags.ravel()


def passes(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if flags.dtype == bool:
        return flags[(keys & np.uint64(len(flags) - 1)).astype(np.int64)]
    low = (keys & np.uint64(8 * len(flags) - 1)).astype(np.int64)
    return (flags[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1


HITS = ["doc_id", "text_key", "key", "pos", "doc_kinds", "doc_plain", "doc_sizes"]
HITS_DDL = "doc_id bigint, text_key int, key bigint, pos bigint, doc_kinds binary, doc_plain binary, doc_sizes binary"


def beside(row: np.ndarray, at: np.ndarray, few: np.ndarray, length: int) -> np.ndarray:
    """Which windows have enough plain words or are linked to such a one by windows that touch."""
    order = np.argsort(at, kind="stable")
    place = at[order]
    group = np.append(0, np.cumsum((np.diff(place) > length) | (np.diff(row[place]) != 0)))
    good = np.bincount(group, weights=~few[order]) > 0
    keep = ~few
    keep[order] |= good[group]
    return keep


def _document_windows(shared, lengths: list[int]):
    def run(batches):
        flags = shared.value
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids, text_keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            for a, b, data, offsets in T.text_pieces(batch.column("text")):
                row, kind, plain = canonical(data, offsets)
                base = np.searchsorted(row, np.arange(b - a + 1))
                rows, kinds, plains, heads, sizes = folded(row, kind, plain)
                for length in lengths:
                    if length < 0:
                        at, keys = whole_keys(row, plain, -length)
                        at, keys = at[passes(flags, keys)], keys[passes(flags, keys)]
                        spans = [slice(i, i - length) for i in at]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids[a + row[at]], pa.int64()), pa.array(text_keys[a + row[at]], pa.int32()), pa.array(keys.view(np.int64)), pa.array(at - base[row[at]]),
                            T.binary([kind[s].tobytes() for s in spans]), T.binary([plain[s].tobytes() for s in spans]), T.binary([b""] * len(at))], names=HITS)
                        continue
                    at, keys, few = window_keys(row, kind, plain, length)
                    hit = passes(flags, keys)
                    at, keys, few = at[hit], keys[hit], few[hit]
                    fold_at, fold_keys, fold_few = window_keys(rows, kinds, plains, length, sizes)
                    hit = passes(flags, fold_keys)
                    fold_at, fold_keys, fold_few = fold_at[hit], fold_keys[hit], fold_few[hit]
                    word = np.concatenate([at, heads[fold_at]])
                    if not len(word):
                        continue
                    keep = beside(row, word, np.concatenate([few, fold_few]), length)
                    word, keys, at, fold_at = word[keep], np.concatenate([keys, fold_keys])[keep], at[keep[:len(at)]], fold_at[keep[len(at):]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[a + row[word]], pa.int64()), pa.array(text_keys[a + row[word]], pa.int32()), pa.array(keys.view(np.int64)),
                        pa.array(word - base[row[word]]),
                        T.binary([kind[i:i + length].tobytes() for i in at] + [kinds[i:i + length].tobytes() for i in fold_at]),
                        T.binary([plain[i:i + length].tobytes() for i in at] + [plains[i:i + length].tobytes() for i in fold_at]),
                        T.binary([b""] * len(at) + [sizes[i:i + length].astype(np.int32).tobytes() for i in fold_at])],
                        names=HITS)
    return run


def renaming(matches) -> tuple[dict, dict, bool]:
    """Placeholders' words of the item to those of the document, the reverse, and whether that is one-to-one and of equal types."""
    there, back, sound = {}, {}, True
    for _, item_kinds, item_plain, doc_kinds, doc_plain, *_ in matches:
        for x, y, u, v in zip(item_kinds, doc_kinds, item_plain, doc_plain):
            if x == PLAIN and y == PLAIN:
                sound &= u == v
            elif x == y or u == v:
                sound &= there.setdefault(u, v) == v and back.setdefault(v, u) == u
            else:
                sound = False
    return there, back, sound


class Piece:
    """The windows of one diagonal, if their placeholders form a one-to-one renaming.

    matches: (at in the item, kinds and plain hashes of the item, the same of the document, then optionally the position in the
    document and the sizes of folded words of both). A contradiction anywhere spoils the renaming: then only windows of equal
    words count.
    """

    def __init__(self, matches, few: bool = False):
        self.few, self.renamed = few, any(m[2] != m[4] for m in matches)
        self.there, self.back, self.sound = renaming(matches)
        if not self.sound:
            matches = [m for m in matches if m[2] == m[4]]
            self.there, self.back, _ = renaming(matches)
        self.covered, self.pairs = set(), {}
        for at, kinds, _, _, _, *place in matches:
            pos, sizes, doc_sizes = place or (at, (), ())
            for own, other in zip(sizes or [1] * len(kinds), doc_sizes or [1] * len(kinds)):
                self.pairs[at] = pos
                self.covered.update(range(at, at + own))
                at, pos = at + own, pos + other
        self.start = min(self.pairs.values(), default=0)


def consistent(matches) -> int:
    """Words of an item covered by the windows of one diagonal."""
    return len(Piece(matches).covered)


def pieces_of(diagonals: dict[tuple, list]) -> list[Piece]:
    """Pieces of matches by (diagonal, its change within the window, whether folded, whether with few plain words).

    Where the unfolded words of a diagonal are mixed up, its other windows don't count; nor do those with few plain words where
    the folded ones are mixed up.
    """
    pieces, mixed = [], set()
    for rank in range(3):
        found = set()
        for (diagonal, shift, folds, few), matches in diagonals.items():
            if rank == (2 if few else int(folds)) and not mixed & {diagonal, diagonal + shift}:
                pieces.append(Piece(sorted(matches), few))
                found |= set() if pieces[-1].sound else {diagonal, diagonal + shift}
        mixed |= found
    return pieces


def agree(a: dict, b: dict) -> bool:
    return all(a.get(k, v) == v for k, v in b.items())


def chained(pieces: list[Piece], words: int) -> tuple[int, bool]:
    """Most words of the item covered by pieces near each other, in order and with one renaming; and whether one is renamed."""
    pieces = sorted((p for p in pieces if p.covered), key=lambda p: p.start)
    starts = [p.start for p in pieces]
    used, best = set(), (0, False)
    for seed in sorted(range(len(pieces)), key=lambda i: -len(pieces[i].covered)):
        p = pieces[seed]
        if p.few or seed in used:
            continue
        covered, pairs, there, back, renamed = set(p.covered), dict(p.pairs), dict(p.there), dict(p.back), p.renamed
        around = range(bisect_left(starts, p.start - NEAR * words), bisect_right(starts, p.start + NEAR * words))
        for i in sorted(around, key=lambda i: -len(pieces[i].covered)):
            q = pieces[i]
            if i == seed or not (agree(pairs, q.pairs) and agree(there, q.there) and agree(back, q.back)):
                continue
            both = sorted((pairs | q.pairs).items())
            if all(x[1] < y[1] for x, y in zip(both, both[1:])):
                covered |= q.covered
                pairs, there, back, renamed = dict(both), there | q.there, back | q.back, renamed or q.renamed
                used.add(i)
        best = max(best, (len(covered), renamed))
    return best


RESULT_DDL = "doc_id bigint, text_key int, item_id bigint, words bigint, matched bigint, renamed boolean"


def _verify(share: float):
    def run(batches):
        for table in runs_of(batches, ["doc_id", "text_key", "item_id", "item_key"]):
            names = "doc_id", "text_key", "item_id", "words", "item_key", "at", "kinds", "plain", "doc_kinds", "doc_plain", "pos", "sizes", "doc_sizes"
            groups: dict[tuple, dict[tuple, list]] = {}
            for doc, key, item, words, item_key, at, kinds, plain, doc_kinds, doc_plain, pos, sizes, doc_sizes in zip(*(table[c].to_pylist() for c in names)):
                own, other = np.frombuffer(sizes, np.int32).tolist(), np.frombuffer(doc_sizes, np.int32).tolist()
                shift = (sum(other) or len(kinds)) - (sum(own) or len(kinds))
                few = plain != doc_plain and 2 * kinds.count(PLAIN) < len(kinds)
                groups.setdefault((doc, key, item, words, item_key), {}).setdefault((pos - at, shift, bool(own or other), few), []).append(
                    (at, kinds, np.frombuffer(plain, np.uint64).tolist(), doc_kinds, np.frombuffer(doc_plain, np.uint64).tolist(), pos, own, other))
            best: dict[tuple, tuple[int, bool]] = {}  # texts of one item are items of their own
            for pair, diagonals in groups.items():
                n, renamed = chained(pieces_of(diagonals), pair[3])
                if n >= share * pair[3]:
                    best[pair] = n, renamed
            out = list(dict.fromkeys((*k[:4], *v) for k, v in best.items()))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                                             names=["doc_id", "text_key", "item_id", "words", "matched", "renamed"])
    return run


def leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id, words of the item, words matched, and whether placeholders were renamed.

    One row a document of documents(doc_id, text) and item of benchmark(item_id, text) that it holds. Texts that share an item_id
    are matched each by itself.
    """
    spark = documents.sparkSession
    texts = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.xxhash64("text").alias("item_key"), "text")
    items = texts.dropDuplicates(["item_id", "item_key"]).mapInArrow(_item_windows, ITEMS_DDL).distinct()
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    shared = spark.sparkContext.broadcast(bit_filter(items))
    keyed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("text_key"), "text")
    hits = keyed.mapInArrow(_document_windows(shared, lengths), HITS_DDL)
    met = hits.join(items, "key").dropDuplicates(["doc_id", "text_key", "item_id", "item_key", "pos", "at", "kinds", "sizes", "doc_sizes"])
    at = ["doc_id", "text_key", "item_id", "item_key"]
    placed = met.repartition(*at).sortWithinPartitions(*at, "pos", "at")
    return placed.mapInArrow(_verify(share), RESULT_DDL)


def remove_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of documents that hold no item, with all their columns."""
    found = leaks(documents, benchmark, share).select(F.col("doc_id").alias("__leak_doc"), F.col("text_key").alias("__leak_key")).distinct()
    return documents.join(found, (F.col("doc_id").cast("bigint") == F.col("__leak_doc")) & (F.hash("text") == F.col("__leak_key")), "left_anti")
