import random

import pytest

from threadloom.llm import leakage as lk

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghijklmnoprstuvz") for _ in range(RNG.randrange(3, 9))) for _ in range(900)]
HANZI = [chr(0x4E00 + k * 7) for k in range(600)]


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    return [(k, " ".join(words(rng, 100))) for k in range(12)] + [(100 + k, "".join(rng.choice(HANZI) for _ in range(240))) for k in range(5)]


def brute_scores(index, query):
    out = []
    for k in range(len(index.ids)):
        score = 0.0
        for t in query:
            docs, impacts, *_ = index.postings.get(t, ([], []))
            if k in docs:
                score += impacts[docs.index(k)]
        if score >= index.threshold[k]:
            out.append(k)
    return out


def test_block_max_wand_retrieves_what_full_scoring_does(items, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK", 3)
    rng = random.Random(2)
    base = [(k, " ".join(rng.choice(VOCAB[:60]) for _ in range(60))) for k in range(40)]
    index = lk.ItemIndex(base)
    index.least = min(index.threshold)
    for _ in range(200):
        k = rng.randrange(40)
        own = index.words[k][rng.randrange(30) :][: rng.randrange(5, 40)]
        query = set(lk.terms(own + [rng.choice(VOCAB[:60]) for _ in range(10)]))
        assert sorted(index.retrieve(query)) == brute_scores(index, query)


def edited(rng, passage, every):
    out = []
    for k, w in enumerate(passage):
        if k % every == every - 1:
            kind = rng.randrange(3)
            out += [[], [w, "inserted"], ["changed"]][kind]
        else:
            out.append(w)
    return out


def test_passages_are_found_whatever_their_form(items):
    rng = random.Random(3)
    index = lk.ItemIndex(items)
    for k in range(12):
        for n in (32, 45, 80):
            part = index.words[k][5 : 5 + n]
            filler = " ".join(words(rng, 300))
            for shown in (" ".join(part).upper(), "> " + " ,\n> ".join(part), "**" + "** ".join(part), " ".join(edited(rng, part, 9)) if n > 40 else " ".join(part)):
                assert lk.leaks_of(f"{filler} {shown} {filler}", index) == [k]


def test_short_overlaps_are_no_case(items):
    index = lk.ItemIndex(items)
    rng = random.Random(4)
    for k in range(12):
        part = " ".join(index.words[k][10:33])
        assert lk.leaks_of(" ".join(words(rng, 100)) + part + " " + " ".join(words(rng, 100)), index) == []


def test_texts_without_spaces(items):
    index = lk.ItemIndex(items)
    text = items[13][1]
    assert lk.leaks_of("開頭" * 50 + text[20:90] + "結尾" * 50, index) == [13]
    assert lk.leaks_of("開頭" * 50 + text[20:60] + "結尾" * 50, index) == []


def test_rows(spark, items):
    passage = items[0][1]
    docs = spark.createDataFrame(
        [(1, passage, 0), (1, passage, 1), (2, None, 0), (3, "", 0), (4, "short", 0), (5, "x " * 200_000 + passage, 0)],
        "doc_id bigint, text string, item_id int",
    )
    held = spark.createDataFrame(
        [(k, t, "x") for k, t in items] + [(0 + 50, passage, "x"), (60, None, "x"), (61, "", "x")],
        "item_id bigint, text string, doc_id string",
    )
    got = sorted(tuple(r) for r in lk.find_leaks(docs, held).collect())
    assert got == sorted([(0, 1), (0, 1), (50, 1), (50, 1), (0, 5), (50, 5)])
    assert lk.find_leaks(docs, held.limit(0)).count() == 0 and lk.find_leaks(docs.limit(0), held).count() == 0


def test_blocks_of_items_give_the_same_pairs(spark, items, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in items], "doc_id bigint, text string")
    held = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(tuple(r) for r in lk.find_leaks(docs, held).collect())
    monkeypatch.setattr(lk, "ITEMS_PER_INDEX", 5)
    assert sorted(tuple(r) for r in lk.find_leaks(docs, held).collect()) == whole == [(k, k) for k, _ in items]


def test_overlaps_of_question_and_rest(spark):
    rng = random.Random(21)
    body, asked = " ".join(words(rng, 60)) + ".", "Which " + " ".join(words(rng, 11)) + "?"
    rows = [(1, f"{' '.join(words(rng, 50))} {body} {asked}"), (2, f"intro {body} tail"), (3, None), (4, ""), (2, f"intro {body} tail")]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id bigint, text string, n_words int")
    others = [(k, " ".join(words(rng, 70)), 0) for k in range(20, 40)]
    items = spark.createDataFrame([(7, f"{body} {asked}", 0), (8, None, 0), *others], "item_id bigint, text string, rest int")
    got = sorted(tuple(r) for r in lk.overlap_report(docs, items).collect())
    assert [(r[0], r[1]) for r in got] == [(7, 1), (7, 2), (7, 2)]
    assert got[0][3] > 0.9 and got[0][4] == 1.0 and got[1][3] < 0.2 and got[1][4] == 1.0 and got[0][2] > got[1][2] >= 58
    assert lk.overlap_report(docs, items.limit(0)).count() == 0 and lk.overlap_report(docs.limit(0), items).count() == 0
