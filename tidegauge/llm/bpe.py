"""Encoding and decoding with a word-level BPE whose words end in a mark, as a tokenizer file of the tokenizers library states it.

Taken from the file: vocabulary, merges, end mark, added tokens. The normaliser is NFC, white space, lower case; the splitter
keeps contractions, runs of letters, single numbers and runs of other signs. Each word is a doubly linked list of
symbols; a priority queue of merge ranks drives it, and entries whose pair is gone are skipped.

Cases: null is an empty text, no ids and an empty decoded text. Words are remembered up to MEMO_WORDS per Python worker,
so memory is bounded for any vocabulary of words; a text is held whole, as its row is.
"""

import hashlib
import heapq
import json
import re
import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, types as S

from tidegauge.llm.text import Memo, worker_memo

MEMO_WORDS = 400_000
ROWS = 512
# White space of the file's patterns, contractions that are words of their own, bytes that stand for themselves.
WHITE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> list[str]:
    """A printable letter for every byte: itself, or the next from 256 on."""
    spare = iter(range(256, 512))
    plain = set(PLAIN_BYTES)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def category_class(kind: str) -> str:
    """The inside of a character class with all code points of a Unicode category."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class WordBpe:
    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"]:
            raise ValueError("a BPE model with an end-of-word mark and no prefix of inner pieces is expected")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.mark = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges = {(self.vocabulary[a], self.vocabulary[b]): (rank, self.vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.letters = byte_letters()
        names = {i: t for t, i in chain(self.vocabulary.items(), self.added.items())}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.numbers = [str(i) for i in range(len(self.names))]
        letter, number = category_class("L"), category_class("N")
        self.ascii_words = re.compile(f"{CONTRACTIONS}|[a-z]+|[0-9]|[^{WHITE}a-z0-9]+")
        self.all_words = re.compile(f"{CONTRACTIONS}|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+")
        self.memo = Memo(self.word, MEMO_WORDS)

    def word(self, word: str) -> tuple[int, ...]:
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.mark
        return self.merge([self.vocabulary[c] for c in letters if c in self.vocabulary])

    def merge(self, ids: list[int]) -> tuple[int, ...]:
        """Apply the lowest rank first, leftmost among equals."""
        merges, end = self.merges, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(*found, i) for i in range(end - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        queue = [(rank, i, new) for rank, new, i in queue]
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j == end or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # stale: one of the pair has merged since
            ids[i], ids[j] = new, -1
            after[i] = right = after[j]
            if right < end:
                before[right] = i
                if found := merges.get((new, ids[right])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            left = before[i]
            if left >= 0 and (found := merges.get((ids[left], new))):
                heapq.heappush(queue, (found[0], left, found[1]))
        return tuple(x for x in ids if x >= 0)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter by itself, without the final sigma
        return self.all_words.findall(text)

    def encode(self, text: str) -> list[int]:
        if self.split_added is None or not any(t in text for t in self.added):
            return list(chain.from_iterable(map(self.memo.__getitem__, self.words(text))))
        ids = []
        for k, part in enumerate(self.split_added.split(text)):
            ids += [self.added[part]] if k % 2 else chain.from_iterable(map(self.memo.__getitem__, self.words(part)))
        return ids

    def decode(self, ids) -> str:
        """Vocabulary strings, joined by a space where the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))

    def numbered(self, ids) -> str:
        return " ".join(map(self.numbers.__getitem__, ids))


def _file(df: DataFrame, path: str):
    """The tokenizer file, read once by the driver; its size is that of a vocabulary, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _coder(shared, path: str) -> WordBpe:
    return worker_memo(f"bpe {path}", lambda: WordBpe(shared.value))


def encode(documents: DataFrame, path: str, column: str = "text") -> DataFrame:
    """All columns and `ids` (array<int>), replacing a column of that name."""
    shared, rest = _file(documents, path), documents.drop("ids")

    def run(batches):
        coder = _coder(shared, path)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])
    return rest.mapInArrow(run, S.StructType([*rest.schema.fields, S.StructField("ids", S.ArrayType(S.IntegerType()))]))


def decode(tokens: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """All columns and `decoded` (string), replacing a column of that name; null ids decode to an empty text."""
    shared, rest = _file(tokens, path), tokens.drop("decoded")

    def run(batches):
        coder = _coder(shared, path)
        for batch in batches:
            texts = [coder.decode(x or ()) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
    return rest.mapInArrow(run, S.StructType([*rest.schema.fields, S.StructField("decoded", S.StringType())]))


def digests(documents: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the ids: encode and decode in one pass."""
    shared = _file(documents, path)
    names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        coder = _coder(shared, path)
        sha = hashlib.sha256
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, rows, kept = batch.slice(start, ROWS), [], []
                for text in part.column("text"):
                    found = coder.encode(text.as_py() or "")
                    rows.append((len(found), sha(coder.numbered(found).encode()).hexdigest(), sha(coder.decode(found).encode()).hexdigest()))
                    if ids:
                        kept.append(found)
                columns = [part.column("doc_id")] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * ids, names=["doc_id", *names] + ["ids"] * ids)
    return documents.select("doc_id", "text").mapInArrow(run, ddl)
