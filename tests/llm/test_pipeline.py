"""The pipeline on a small corpus against a plain version of each stage."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from shapeloom.llm import simhash, token_files, toxicity


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    plain = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(240):
        words = rng.choices(plain, k=rng.randint(20, 60))
        if i % 5 == 0:
            words[3:3] = ["vile", "awful", "rotten"]
        docs.append((i, " ".join(words), "en", f"s{i % 3}" if i % 7 else None, 1))
    passage = " ".join(rng.choices(plain, k=25))
    docs += [(240, docs[1][1], "en", "s1", 1), (241, f"x y {passage} z", "en", "s2", 1), (242, "", "en", "s1", 1), (243, None, "en", "s1", 1)]
    labels = [(i, int(i % 5 == 0), 1) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()

    model = toxicity.fit([(docs[i][1], y) for i, y, _ in labels])
    left = [d for d in docs if model.severity(d[1])[1] < 1]
    assert {d[0] for d in docs} - {d[0] for d in left} >= set(range(0, 200, 5)) - {d[0] for d in left}
    assert len(docs) - len(left) in range(44, 54)
    kept, fps = [], []
    for d in left:  # by doc_id: a group's least comes first
        fp = simhash.fingerprint(d[1])
        if all((fp ^ x).bit_count() > 3 for x in fps):
            kept.append(d)
        fps.append(fp)
    w = passage.split()
    grams = {" ".join(w[i : i + 10]) for i in range(16)}
    clean = [d for d in kept if not any(f" {g} " in f" {d[1]} " for g in grams)]
    assert {d[0] for d in kept} - {d[0] for d in clean} == {241}

    times, size = Counter(r.doc_id for r in got), {d[0]: len(re.findall(r"\S+", d[1] or "")) for d in clean}
    assert set(times) <= set(size) and max(times.values()) <= 2 and 242 in times
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken - 1.5 * sum(size.values())) < 200
    tok, start = Tokenizer.from_file(token_files.default_tokenizer()), 0
    text = {d[0]: d[1] for d in docs}
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    for r in got:
        ids = [*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
