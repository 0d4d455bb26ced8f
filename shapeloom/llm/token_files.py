"""Token ids in Simple-8b files.

Every text is encoded by a public tokenizer; an end id follows each document. Ids are packed into 64-bit words: four
selector bits say how many ids a word holds (60 of 1 bit, 30 of 2, ... 1 of 60); selector 15 is an escape,
whose word holds nothing itself: the next word is one raw id. The layout is greedy: each word takes as many ids as fit.

A file is a Parquet file whose rows are blocks of whole documents, in ascending order of doc_id over all files:
part and block (their order), ahead (ids before the block in its part), doc_ids, lengths (ids by document), payload
(little-endian words) and offsets (the word at which each run of SKIP ids starts and how many ids of that word come before
it), so that read_span() starts within a block. Words decode by selector, all words of one selector at once.

Documents are dealt by ranges of doc_id, and among equal ones of their place in the input, and encoded as they are read, one block in
memory at a time. Where a document starts in the whole is the sum of the parts before, of blocks before in its part, and of documents
before in its block; only the parts' sums, one row for each file, are broadcast, so payloads are never shuffled.

Texts are cut at line ends, at single blanks between other characters, and before a single mark between a letter and white space; there
the tokenizer's own splits always fall. Equal pieces of a batch are encoded once, and each worker keeps the ids of up to KEPT pieces.
A piece of letters alone, of the scripts up to Armenian, is one word to the tokenizer and goes straight to its model; all other pieces, and
texts with other white space, go through the whole tokenizer.

Null and empty texts have only the end id. A null doc_id comes first; rows that repeat a doc_id follow each other in the order of the
input. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import lean, ship, stored, table

ship(__name__)

END = 2
#: Ids of a block, about; ids between two offsets; bytes of text encoded at once; pieces that a worker keeps.
BLOCK, SKIP, BATCH_BYTES, KEPT = 1 << 18, 1 << 12, 8 << 20, 400_000
#: Fixed: ids in a word and bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
_WIDTHS = np.array([i.bit_length() for i in range(1 << 16)], "u1")
#: Letters below this code point are letters in all versions of Unicode.
_SURE = "\u0530"
#: White space other than single blanks and line ends between other characters (RE2).
_ODD = (
    "^[ \\n]|[ \\n]$|[ \\n][ \\n]|"
    "[\\t\\x0b-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
#: A letter, one mark, and white space or the end (RE2).
_MARKED = "([A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}])([,.;:!?])([ \\n]|$)"
#: First characters of pieces, which other texts have not: text, end, odd text, mark; a line's first piece begins with its line end.
_TEXT, _END, _WHOLE, _MARK = "\r", "\t", "\x0b", "\x0c"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of ids (unsigned), and the number of ids that each word holds (0: an escape)."""
    n = len(ids)
    if not n:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    ids = ids.astype("u8")
    top = int(ids.max())
    if top < len(_WIDTHS):
        width = _WIDTHS[ids]
    else:
        width = np.zeros(n, "u1")
        for b in range(top.bit_length()):
            width += ids >= np.uint64(1 << b)
    # best[i]: the selector with most ids from i on; widest so far grows with the count
    best, widest, have = np.full(n, ESCAPE, "u1"), width.copy(), 1
    for s in range(len(COUNTS) - 1, -1, -1):
        m = n - COUNTS[s] + 1
        if m <= 0:
            break
        while have < COUNTS[s]:
            widest[: n - have] = np.maximum(widest[: n - have], width[have:])
            have += 1
        fits = widest[:m] <= BITS[s]
        if not fits.any():
            break
        best[:m][fits] = s
    starts = _walk(np.array([*COUNTS, 1, 1])[best])
    chosen = best[starts]
    slots = 1 + (chosen == ESCAPE)
    at = np.cumsum(slots) - slots
    words, held = np.zeros(int(slots.sum()), "u8"), np.zeros(int(slots.sum()), "i8")
    for s in np.unique(chosen):
        mine = chosen == s
        if s == ESCAPE:
            words[at[mine]] = np.uint64(ESCAPE << 60)
            words[at[mine] + 1] = ids[starts[mine]]
            held[at[mine] + 1] = 1
            continue
        k = COUNTS[s]
        w = np.full(int(mine.sum()), int(s) << 60, "u8")
        first = starts[mine]
        for j in range(k):
            w |= ids[first + j] << np.uint64(j * BITS[s])
        words[at[mine]], held[at[mine]] = w, k
    return words, held


def _walk(step: np.ndarray) -> np.ndarray:
    """0, step[0], and so on: the places that a walk meets which goes step[i] ahead from i. Every 64th is found first."""
    n = len(step)
    ahead = np.minimum(np.arange(n + 1) + np.append(step, 0), n)
    far = ahead
    for _ in range(6):
        far = far[far]
    heads = [0]
    while (i := int(far[heads[-1]])) < n:
        heads.append(i)
    rows = [np.array(heads)]
    for _ in range(63):
        rows.append(ahead[rows[-1]])
    met = np.stack(rows, 1).ravel()
    return met[met < n]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids (uint64) of words."""
    selector = (words >> np.uint64(60)).astype("u1")
    raw = np.zeros(len(words), bool)
    # an escape makes the next word raw, whatever its top bits are
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    count = np.array([*COUNTS, 0, 0])[selector]
    count[raw] = 1
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), "u8")
    out[start[raw]] = words[raw]
    for s in np.unique(selector[~raw]):
        if s == ESCAPE:
            continue
        mine = np.flatnonzero((selector == s) & ~raw)
        w, first, mask = words[mine], start[mine], np.uint64((1 << BITS[s]) - 1)
        for j in range(COUNTS[s]):
            out[first + j] = (w >> np.uint64(j * BITS[s])) & mask
    return out


def _kept(path: str) -> types.ModuleType:
    """What this worker process keeps: the tokenizer, the pieces it has met (keys) and where their ids are in the pool."""
    name = "_token_files_kept"
    kept = sys.modules.get(name)
    if kept is None or kept.path != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        kept = types.ModuleType(name)
        kept.path, kept.tokenizer = path, Tokenizer.from_file(path)
        kept.model, splits, kept.odd = kept.tokenizer.model, kept.tokenizer.pre_tokenizer, 0
        letters = [c for c in map(chr, range(ord(_SURE))) if c == " " or c.isalpha()]
        kept.spelling = {ord(c): "".join(x for x, _ in splits.pre_tokenize_str(c)) for c in letters}  # in the model's alphabet
        _forget(kept)
        sys.modules[name] = kept
    return kept


def _forget(kept: types.ModuleType) -> None:
    kept.keys, kept.start, kept.size, kept.pool = pa.array([], pa.string()), np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0, "<u4")


def _learn(kept: types.ModuleType, new: list[str], odd: dict[str, str], end: int) -> None:
    """Adds the pieces new to those kept. Most follow a blank; the others tell by their first character what they are."""
    found: list[list[int]] = []
    whole, at = [], []  # what the whole tokenizer takes, and its place in found
    word, spelling, blank = kept.model.tokenize, kept.spelling, kept.spelling[32]
    for x in new:
        if x.isalpha() and (x.isascii() or max(x) < _SURE):
            found.append([t.id for t in word(blank + (x if x.isascii() else x.translate(spelling)))])
        elif x == _END:
            found.append([end])
        else:
            first = x[:1]
            at.append(len(found))
            found.append([])
            whole.append(odd[x] if first == _WHOLE else x[1:] if first == _TEXT or first == _MARK else x if first == "\n" else " " + x)
    for k in range(0, len(whole), 1000):
        for i, e in zip(at[k : k + 1000], kept.tokenizer.encode_batch_fast(whole[k : k + 1000], add_special_tokens=False), strict=True):
            found[i] = e.ids
    size = np.fromiter(map(len, found), "i4", len(found))
    flat = np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))
    kept.start = np.concatenate([kept.start, (len(kept.pool) + np.cumsum(size) - size).astype("i4")])
    kept.size = np.concatenate([kept.size, size])
    kept.pool = np.concatenate([kept.pool, flat])
    kept.keys = pa.concat_arrays([kept.keys, pa.array(new, pa.string())])


def encode(texts: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The ids (unsigned) of all texts one after another, each with its end id, and their number by text."""
    kept = _kept(path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    strange = pc.match_substring_regex(texts, _ODD)
    cut = pc.replace_substring_regex(texts, _MARKED, f"\\1 {_MARK}\\2\\3")
    cut = pc.binary_join_element_wise(_TEXT, pc.replace_substring(cut, "\n", " \n"), f" {_END}", "")
    odd: dict[str, str] = {}
    if pc.any(strange).as_py():
        where = np.flatnonzero(strange.to_numpy(zero_copy_only=False))
        names = [None] * len(texts)
        for i in where.tolist():
            kept.odd += 1
            odd[f"{_WHOLE}{kept.odd}"], names[i] = texts[i].as_py(), f"{_WHOLE}{kept.odd} {_END}"
        cut = pc.if_else(strange, pa.array(names, pa.string()), cut)
    split = pc.split_pattern(cut, " ")
    pieces = split.flatten().dictionary_encode()
    known = pc.index_in(pieces.dictionary, value_set=kept.keys)
    if known.null_count:
        if len(kept.keys) > KEPT or len(kept.pool) > 16 * KEPT:  # only those of this text batch stay
            _forget(kept)
            new = pieces.dictionary
        else:
            new = pieces.dictionary.filter(pc.is_null(known))
        _learn(kept, new.to_numpy(zero_copy_only=False).tolist(), odd, end)
        known = pc.index_in(pieces.dictionary, value_set=kept.keys)
    of = known.to_numpy()[pieces.indices.to_numpy()]
    size = kept.size[of]
    upto = np.cumsum(size, dtype="i4")
    at = np.repeat(kept.start[of] - upto + size, size)
    at += np.arange(len(at), dtype="i4")
    ids = kept.pool[at]
    lasts = split.offsets.to_numpy()[1:] - split.offsets[0].as_py() - 1  # each text has pieces: its end at least
    return ids, np.diff(upto[lasts], prepend=0)


def _batches(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column of texts, of about BATCH_BYTES each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8"))
    cuts = [0, *(np.flatnonzero(np.diff(upto // BATCH_BYTES)) + 1).tolist(), len(column)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield column.slice(a, b - a)


def _block(doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray, part: int, block: int, ahead: int) -> pa.RecordBatch:
    words, held = pack(ids)
    upto = np.cumsum(held)
    marks = np.arange(0, len(ids), SKIP)
    word = np.searchsorted(upto, marks, side="right")
    skip = marks - (upto[word] - held[word])
    word = np.where((word > 0) & (held[np.maximum(word - 1, 0)] == 0), word - 1, word)  # an escape comes along
    offsets = pa.StructArray.from_arrays([pa.array(word, pa.int32()), pa.array(skip, pa.int32())], names=["word", "skip"])

    def one(x: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    columns = {
        "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "ahead": pa.array([ahead], pa.int64()),
        "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": one(doc_ids), "lengths": one(pa.array(lengths, pa.int32())),
        "payload": pa.array([words.astype("<u8").tobytes()], pa.binary()), "offsets": one(offsets),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def write_files(docs: DataFrame, tokenizer_path: str, end: int = END, name: str = "token-files") -> DataFrame:
    """Encodes docs into files in the shared folder; returns them as read back: part, block, ahead, n_ids, doc_ids, ..."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of short lists, no cycles
        names, ids, lengths, n, block, part, ahead = [], [], [], 0, 0, 0, 0

        def done() -> pa.RecordBatch:
            return _block(pa.concat_arrays(names), np.concatenate(ids), np.concatenate(lengths), part, block, ahead)

        for b in batches:
            if not b.num_rows:
                continue
            part, row = b.column("part")[0].as_py(), 0
            for texts in _batches(b.column("text")):
                found, sizes = encode(texts, tokenizer_path, end)
                upto, i = np.cumsum(sizes), 0
                while i < len(sizes):  # documents up to the one that fills the block
                    before = int(upto[i - 1]) if i else 0
                    j = min(len(sizes), int(np.searchsorted(upto, before + BLOCK - n, side="left")) + 1)
                    names.append(b.column("doc_id").slice(row + i, j - i))
                    ids.append(found[before : upto[j - 1]])
                    lengths.append(sizes[i:j])
                    n += int(upto[j - 1]) - before
                    i = j
                    if n >= BLOCK:
                        yield done()
                        names, ids, lengths, block, ahead, n = [], [], [], block + 1, ahead + n, 0
                row += len(sizes)
        if names:
            yield done()

    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    blocks = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(
        lean(run),
        f"part int, block int, ahead long, n_ids long, doc_ids array<{kind}>, lengths array<int>, payload binary, "
        "offsets array<struct<word:int,skip:int>>",
    )
    return stored(blocks, name)


def _placed(files: DataFrame) -> DataFrame:
    """files with first: the ids of all files before the block. Only the sums of parts are broadcast, one row for each file."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    found = files.join(F.broadcast(parts), F.col("part") == F.col("_part"))
    return found.select((F.col("before") + F.col("ahead")).alias("first"), "doc_ids", "lengths", "n_ids", "payload", "offsets")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of each document."""

    def lists(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids.astype("i4")))

    return _read(files, "ids array<int>", lists)


def _read(files: DataFrame, column: str, value) -> DataFrame:
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = unpack(np.frombuffer(b.column("payload")[i].as_buffer(), "<u8")).astype("<u4")
                lengths = b.column("lengths")[i].values.to_numpy().astype("i8")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[i].values, pa.array(b.column("first")[i].as_py() + ends - lengths), pa.array(lengths), value(ids, lengths)],
                    names=["doc_id", "start", "n_tokens", name],
                )

    placed = _placed(files).select("first", "doc_ids", "lengths", "payload")
    return placed.mapInArrow(lean(run), f"doc_id {kind}, start long, n_tokens long, {column}")


def _crcs(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    raw, ends = memoryview(ids.tobytes()), (4 * np.cumsum(lengths)).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.int64())


def read_span(files: DataFrame, start: int, n: int) -> np.ndarray:
    """The n ids from the start-th of all files on. Only blocks that hold some of them are read, and only from the nearest offset on."""
    some = _placed(files).where((F.col("first") < start + n) & (F.col("first") + F.col("n_ids") > start)).orderBy("first")
    out = []
    for r in some.select("first", "n_ids", "payload", "offsets").toLocalIterator():
        low, high = max(0, start - r["first"]), min(r["n_ids"], start + n - r["first"])
        mark, stop = r["offsets"][low // SKIP], r["offsets"][-(-high // SKIP) :]
        words = np.frombuffer(r["payload"], "<u8")[mark["word"] : stop[0]["word"] + 2 if stop else None]
        if words.size and stop and (words[-1] >> np.uint64(60)) == ESCAPE:
            words = words[:-1]  # the raw id of an escape that was cut off
        at = low % SKIP + mark["skip"]
        out.append(unpack(words)[at : at + high - low])
    return np.concatenate(out) if out else np.zeros(0, "u8")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_table(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as read back from the files."""
    return _read(write_files(docs, tokenizer_path, end), "ids_crc32 long", _crcs)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
