"""Counting the pieces of the best unigram segmentation without making them.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character, longest first. A forward pass carries
the best score and the number of pieces to each end. A later start replaces an earlier one only by a better score,
so of equal paths the one with the longest last piece wins, as in the tokenizers library. A character without
a piece of its own costs the lowest score less 10; it counts as its bytes with byte fallback, else a run of them counts as one.

Spaces are word marks and every text begins with one. Where no piece has a mark after another character, words are
independent, and each distinct one is solved once per Python worker (at most MEMO_WORDS are remembered).

Cases: null and empty texts have 0 pieces; a text is held whole, as its row is.
"""

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.text import Memo, worker_memo

MEMO_WORDS = 400_000
# The word mark, and what an unknown character costs below the lowest score.
MARK = "▁"
UNKNOWN_COST = 10.0


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in reversed(pieces):  # the first of equal pieces stays
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        names = {p for p, _ in pieces}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.single = {p for p in names if len(p) == 1}
        apart = MARK in names and not any(MARK in p.lstrip(MARK) for p in names)
        lines = self.byte_fallback and not any("\n" in p for p in names)
        pattern = f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+" if lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        self.words = re.compile(pattern).findall if apart else lambda text: [text]
        self.memo = Memo(self.solve, MEMO_WORDS if apart else 1)

    def solve(self, word: str) -> int:
        """Pieces on the best path through a word."""
        n = len(word)
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ends[last + 1].append(match)
        for end in range(1, n + 1):
            best = None
            for length, own in ends[end]:
                total = score[end - length] + own
                if best is None or total > best:
                    best, start = total, end - length
            unknown = word[end - 1] not in self.single and (best is None or score[end - 1] + self.unknown > best)
            if unknown:
                best = score[end - 1] + self.unknown
                more = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else not loose[end - 1]
                count[end] = count[end - 1] + more
            else:
                count[end] = count[start] + 1
            score[end], loose[end] = best, unknown
        return count[n]

    def count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.words(MARK + text.replace(" ", MARK)))) if text else 0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in order of their ids."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def token_counts(documents: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True, name: str = "pieces") -> DataFrame:
    """doc_id, n_tokens of every row of documents(doc_id, text). `name` keys the automaton that a Python worker keeps."""
    shared = documents.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary, whatever the input

    def run(batches):
        counter = worker_memo(f"unigram {name} {len(pieces)} {byte_fallback}", lambda: UnigramCounter(shared.value, byte_fallback))
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
