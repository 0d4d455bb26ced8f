"""Stages that drop rows judge each row for itself, also where doc_id is null or repeated."""

import random
from collections import Counter

from shapeloom.llm import decontamination, simhash

BIG = 2**60 + 1


def _docs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(30)]
    passage = " ".join(rng.choices(words, k=20))
    rows = [(i if i % 3 else None, t, f"s{i}") for i, t in enumerate(texts)]
    rows += [
        (None, f"a {passage} b", "x1"), (None, f"c d {passage}", "x2"), (None, texts[0], "x3"), (None, texts[1], "x4"), (None, None, "x5"),
        (4, texts[7], "x6"), (4, f"e {passage}", "x7"), (5, texts[5], "x8"), (5, " ".join(rng.choices(words, k=50)), "x9"),
        (BIG, " ".join(rng.choices(words, k=50)), "x10"), (BIG + 1, texts[8], "x11"), (2, "", "x12"),
    ]
    return rows, passage, spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)


def test_only_contaminated_rows_go(spark):
    rows, passage, docs = _docs(spark)
    tests = spark.createDataFrame([(1, passage)], "item_id long, text string")
    w = passage.split()
    grams = [" ".join(w[i : i + 10]) for i in range(len(w) - 9)]
    want = [r for r in rows if not any(f" {g} " in f" {r[1] or ''} " for g in grams)]
    assert len(rows) - len(want) == 3
    got = decontamination.drop_contaminated(docs, tests)
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_one_row_of_each_group_stays(spark):
    rows, _, docs = _docs(spark)
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    groups: list[list] = []
    for r in rows:
        near = [g for g in groups if any((simhash.fingerprint(r[1]) ^ simhash.fingerprint(x[1])).bit_count() <= 3 for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [r])]
    assert len(got) == len(groups) and not Counter(got) - Counter(rows)
    for g in groups:
        (kept,) = [r for r in got if r in g]
        assert kept[0] == min((r[0] for r in g if r[0] is not None), default=None)
