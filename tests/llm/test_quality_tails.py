"""Rules find bad rows in a tail under an eighth of the rows, though some good rows share the statistic."""

import random

from pyspark.sql import functions as F

from shapeloom.llm import quality_rules

KINDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, good int"


def test_a_tail_among_noise(spark):
    for noise in (0.0, 0.01, 0.02, 0.1):
        rng = random.Random(5)
        rows = []
        for i in range(3600):
            n, bad = rng.randint(60, 400), rng.random() < 0.08
            symbols = rng.randint(int(0.3 * n), n) if bad else int(rng.random() < noise)
            rows.append((i, n, 5 * n + rng.randint(0, n), symbols, 0, rng.randint(0, n // 4), int(not bad)))
        labelled = spark.createDataFrame(rows, KINDS)
        keep = quality_rules.keep_expression(quality_rules.with_margins(labelled, quality_rules.learn(labelled)))
        n = {(r.good, r.k): r.n for r in labelled.groupBy("good", keep.alias("k")).agg(F.count("*").alias("n")).collect()}
        assert n[0, False] >= 0.97 * sum(v for (good, _), v in n.items() if not good), (noise, n)
        assert n.get((1, False), 0) <= 3, (noise, n)
