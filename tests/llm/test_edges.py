"""Ids that are null, repeated, beyond 2**53 or texts; balance, gradients and verdicts against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shapeloom.llm import chat_tree, decontamination, line_runs, quality_rules, sharding, simhash, token_files, toxicity

BIG = 2**60 + 1
LINE = "a line that stands in many documents"
ROWS = [
    (None, f"{LINE}\nx"), (BIG, f"y\n{LINE}"), (BIG + 1, LINE), (3, "z"), (3, f"{LINE}\nw"), (None, f"{LINE}\nx"), (4, None), (5, ""),
]


def _docs(spark, kind="long"):
    cast = str if kind == "string" else int
    return spark.createDataFrame([(None if i is None else cast(i), t) for i, t in ROWS], f"doc_id {kind}, text string").repartition(2)


def test_ids_pass_through_as_they_are(spark):
    want = Counter((i, simhash.fingerprint(t)) for i, t in ROWS)
    got = simhash.near_duplicates(_docs(spark)).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == want
    scored = toxicity.score(_docs(spark), toxicity.Model({b"line": 1.0}, (0.5, 1.0, 1.5))).collect()
    assert Counter((r.doc_id, r.grade) for r in scored) == Counter((i, 2 if "line" in (t or "") else 0) for i, t in ROWS)
    assert toxicity.score(_docs(spark).limit(0), toxicity.Model({}, (1.0,) * 3)).count() == 0


def test_token_files_of_odd_ids_and_spans(spark):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    tok = Tokenizer.from_file(path)
    files = token_files.write_files(_docs(spark), path)
    got = token_files.read_documents(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    flat = [x for r in got for x in r.ids]
    for a, n in ((0, 5), (7, 20), (len(flat) - 3, 10)):
        assert token_files.read_span(files, a, n).tolist() == flat[a : a + n]
    assert token_files.token_table(_docs(spark).limit(0), path).count() == 0


def test_spans_start_at_offsets():
    import pyarrow as pa

    ids = np.random.default_rng(1).integers(0, 2**20, 20_000).astype("u8")
    ids[::977] = 2**61
    b = token_files._block(pa.array([1]), ids, np.array([len(ids)]), 0, 0, 0)
    words = np.frombuffer(b.column("payload")[0].as_buffer(), "<u8")
    for k, mark in enumerate(b.column("offsets")[0].as_py()):
        assert (token_files.unpack(words[mark["word"] :])[mark["skip"] :] == ids[k * token_files.SKIP :]).all()


def test_lines_and_benchmark_with_any_ids(spark):
    for kind in ("long", "string"):
        cast = str if kind == "string" else int
        ids = [None if i is None else cast(i) for i, _ in ROWS]
        order = sorted({i for i in ids if i is not None})
        last = max(i for i, (_, t) in zip(ids, ROWS) if i is not None and LINE in (t or ""))
        got = line_runs.drop_repeated(_docs(spark, kind)).collect()
        want = [(i, "\n".join(x for x in (t or "").split("\n") if x != LINE or i == last)) for i, (_, t) in zip(ids, ROWS)]
        assert Counter((r.doc_id, r.kept) for r in got) == Counter(want) and order
        tests = spark.createDataFrame([(1, LINE)], "item_id long, text string")
        found = decontamination.contaminated(_docs(spark, kind), tests).collect()
        assert Counter((r.doc_id, r.n_hit) for r in found) == Counter((i, 7 if LINE in (t or "") else 0) for i, (_, t) in zip(ids, ROWS))


def test_shards_are_near_equal_in_all_tiers(spark):
    rng = random.Random(4)
    sizes = {i: rng.randint(1, 3000) if i % 40 else rng.randint(20_000, 60_000) for i in range(800)}
    groups = spark.createDataFrame(list(sizes.items()), "g long, size long")

    def spread(of):
        sums = [0] * 16
        for g, s in of.items():
            sums[s] += sizes[g]
        return (max(sums) - min(sums)) / sum(sums) * 16

    plain = spread(sharding.karmarkar_karp(sizes, 16))
    tiers = spread({r.g: r.shard for r in sharding.shard_groups(groups, 16, task_groups=100).collect()})
    assert plain < 0.01 and tiers < 0.01
    rows = spark.createDataFrame([(None, "same")] * 3000 + [(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    got = sharding.assign_shards(rows).collect()
    assert len(got) == 3050 and len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same")}) == 1
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_gradient_and_ordered_thresholds():
    rng = np.random.default_rng(2)
    x, grade = rng.random((40, 6)), rng.integers(0, toxicity.GRADES + 1, 40)
    share, w = rng.random(40), np.concatenate([rng.random(6), [0.2, 0.9, 1.7]])

    def plain(w):  # the likelihood from its definition
        total = 0.0
        for row, g, s in zip(x, grade, share, strict=True):
            at_least = [1.0, *(1 / (1 + np.exp(-(row @ w[:6] - t))) for t in w[6:]), 0.0]
            total += s * np.log(at_least[g] - at_least[g + 1])
        return total

    value, gradient = toxicity.likelihood(w, x, grade, share)
    assert abs(value - plain(w)) < 1e-9
    for i in range(len(w)):
        step = np.eye(len(w))[i] * 1e-6
        assert abs(gradient[i] - (plain(w + step) - plain(w - step)) / 2e-6) < 1e-5
    rows = [(f"bad{' awful' * (i % 5)} w{i}", 1) for i in range(60)] + [(f"w{i} v{i}", 0) for i in range(90)]
    model = toxicity.fit([*rows, ("bad w1", 0)])  # labelled both ways: toxic
    a, b, c = model.thresholds
    assert a < b < c and all(v >= 0 for v in model.weights.values())


def test_quality_of_all_columns(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(80)) + (" #$|" * (i % 4 == 0) * 30) for i in range(160)]
    texts += ["a b", "", None, "x y z " * 40, "l\nl\n \n" + texts[1], "w " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(120)] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        held = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
        r, failed = got[i], len(w) < 50 or 100 * len(held) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(held), failed,
        )
        assert r.kept == (not failed and not (i < 160 and i % 4 == 0))


def test_long_roles_null_conversations_and_repeats(spark):
    rows = [(None, 0, "r<" * 20_000, "x"), (None, 0, "r<" * 20_000, "x"), (1, None, "user", "a"), (1, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.t.role, t.t.text) for t in r.turns] for r in chat_tree.read_back(*chat_tree.emit(df)).collect()}
    assert got == {None: [("r<" * 20_000, "x")] * 2, 1: [("user", "a"), ("user", "")]}
