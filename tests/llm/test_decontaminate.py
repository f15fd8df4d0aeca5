import random
import re

import numpy as np
import pytest

from tidegauge.llm import decontaminate as D

ITEMS = [(1, "If Anna buys 12 apples for 3 dollars each and sells them to Peter for 5 dollars each, how much does Anna earn in 7 days?"),
         (2, "Der schnelle braune Fuchs springt über den faulen Hund und läuft danach in den Wald"), (3, "short item here"), (4, None), (5, "four plain little words")]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in D.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}


def test_renamed_questions(spark):
    texts = [
        "Some words before. " + ITEMS[0][1] + " And words after.",
        "If Maria buys 40 apples for 9 dollars each and sells them to Karl for 11 dollars each, how much does Maria earn in 2 days?",
        # the second mention of the buyer is someone else, so is a third name
        "If Maria buys 40 apples for 9 dollars each and sells them to Maria for 9 dollars each, how much does Karl earn in 9 days?",
        "if anna buys 12 apples for 3 dollars each and sells them to peter for 5 dollars each, how much does anna earn in 7 days?",
        "DER SCHNELLE BRAUNE FUCHS SPRINGT ÜBER DEN FAULEN HUND UND",
        "der schnelle *braune* fuchs, springt über den faulen hund und läuft heim",
        "Short item, here!", "see: four plain little words!", "1 2 3 4 5 6 7 8 9 10 11 12 Anna Peter 5 6 7 8", "", "a short item here", "short item"]
    got = found(spark, texts)
    assert {(0, 1), (1, 1), (3, 1), (5, 2), (6, 3), (7, 5)} <= got
    assert not got & {(2, 1), (8, 1), (9, 1), (10, 3), (11, 3)}


def test_renamings_that_change_the_number_of_words(spark):
    item = ("If we know that Peter walks to the old green market with 12 heavy bags of corn and then runs for 5 km along "
            "the long river before he meets Anna at home again")
    longer = item.replace("Peter", "Karl Smith").replace("12", "1 200").replace("5 km", "7km").replace("Anna", "Maria Lopez")
    inserted = item.replace("old green", "old and green").replace("bags of", "bags full of").replace("the long", "the very long").replace("he meets", "he then meets")
    rich = "Yesterday our friend gave Anna 4 , Tom 5 , Eva 6 and Max 7 , Ida 8 , Ben 9 marbles"
    other = "Yesterday our friend gave Lisa 11 , Paul 12 , Nora 13 and Otto 14 , Rosa 15 , Emil 16 marbles"
    table = "so Lisa 11 , Paul 12 , Nora 13 and Otto 14 , Rosa 15 , Emil 16"
    texts = [item, longer, inserted, item.lower(), other, table, "nothing of it"]
    assert found(spark, texts, [(1, item), (2, rich)]) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)}


def test_texts_of_one_item_are_matched_apart(spark):
    short = "which of the many small birds came back to the old tree before the first snow fell on the hills again today"
    long = "in the long winter " + short + " and who had seen them there in the years before that one without a single word"
    docs = spark.createDataFrame([(1, short), (2, long)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, short), (7, long), (7, long)], "item_id bigint, text string")
    got = {(r.doc_id, r.words, r.matched) for r in D.leaks(docs, items).collect()}
    a, b = len(short.split()), len(long.split())
    assert got == {(1, a, a), (1, b, a), (2, a, a), (2, b, b)}


def test_pieces_are_joined_in_order_and_near():
    plain = lambda at, pos: D.Piece([(at, bytes(8), list(range(8)), bytes(8), list(range(8)), pos, (), ())])
    assert D.chained([plain(0, 0), plain(9, 12), plain(20, 5), plain(20, 500)], 40) == (16, False)
    slot = lambda at, pos, v: D.Piece([(at, bytes([0, D.NAME]), [1, 7], bytes([0, D.NAME]), [1, v], pos, (), ())])
    assert D.chained([slot(0, 0, 8), slot(5, 6, 8)], 10)[0] == 4 and D.chained([slot(0, 0, 8), slot(5, 6, 9)], 10)[0] == 2


def test_consistency_rules():
    name = bytes([D.PLAIN, D.NAME, D.PLAIN, D.NAME])
    def check(doc, item=(1, 7, 2, 7), kinds=name):
        return D.consistent([(0, name, list(item), kinds, list(doc))])
    assert check((1, 7, 2, 7)) == 4 and check((1, 8, 2, 8)) == 4
    assert check((1, 8, 2, 9)) == 0 and check((1, 8, 2, 8), item=(1, 7, 2, 6)) == 0
    assert check((3, 8, 2, 8)) == 0 and check((1, 8, 2, 8), kinds=bytes([0, D.NUMBER, 0, D.NUMBER])) == 0


def test_against_plain_search(spark):
    """Without numbers and names a match is SHARE of the item's windows of plain words in a row."""
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + str(rng.choice("xyz"))
    items = [(k, " ".join(word() for _ in range(rng.randrange(4, 30)))) for k in range(12)]
    texts = []
    for k in range(60):
        text = [word() for _ in range(rng.randrange(40))]
        if k % 2:
            item = rng.choice(items)[1].split()
            a = rng.randrange(len(item))
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[a:] if k % 4 == 1 else item
        texts.append(" ".join(text))
    want = set()
    for d, text in enumerate(texts):
        words = text.split()
        for i, item in items:
            own = item.split()
            n = min(D.WINDOW, len(own))
            diagonals: dict[int, set] = {}
            for p in range(len(words) - n + 1):
                for q in range(len(own) - n + 1):
                    if words[p:p + n] == own[q:q + n]:
                        diagonals.setdefault(p - q, set()).update(range(q, q + n))
            if any(len(c) >= D.SHARE * len(own) for c in diagonals.values()):
                want.add((d, i))
    assert found(spark, texts, items) == want and len(want) >= 20


def test_types():
    data = np.frombuffer("He paid Tom 5 km, in 3.5% Öl. The end Éa".encode(), np.uint8)
    _, kind, _ = D.canonical(data, np.array([0, len(data)]))
    assert kind.tolist() == [0, 0, 2, 1, 3, 0, 1, 2, 0, 0, 2]


def test_large_filter():
    keys = np.arange(1000, dtype=np.uint64) * np.uint64(2654435761)
    flags = np.zeros(1 << 22, bool)
    flags[(keys & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    packed = np.packbits(flags)
    other = keys + np.uint64(1)
    assert D.passes(packed, keys).all() and (D.passes(packed, other) == flags[(other & np.uint64(len(flags) - 1)).astype(np.int64)]).all()


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "long words long words long words long words long words"), (2, "another text under the same id, somewhat longer")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(awkward, items).collect()}
    assert got == {(7, 1), (8, 1), (9, 2)}
    kept = D.remove_leaks(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.remove_leaks(awkward, none).count() == awkward.count()
    assert D.leaks(nothing, items).count() == 0
