"""Token ids in files compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by id. A task encodes its documents, appends the end id to each, and cuts
them into blocks of about ``BLOCK`` ids (a document is never cut). Each block is one row of a Parquet table:

    part, block       order of the blocks
    at                ids of the part before the block
    doc_ids, lengths  its documents and their numbers of ids, end id included
    alphabet          distinct ids (uint32); symbol s below their number stands for alphabet[s]
    rules             two symbols (uint32) for each nonterminal, which follow the alphabet in number
    expansions        how many ids each nonterminal stands for (uint32)
    body              the block as symbols (uint32, first all lower halves and then all upper ones)

Compression repeats rounds until no pair of neighbouring symbols is frequent, which means ``LEAST`` places or more: a
round counts all pairs (a sort) and replaces each frequent pair wherever it is more frequent than the pairs that overlap
it there. There is no limit of rounds, pairs or symbols. A pair that was rare stays rare until one of its symbols
changes, so later rounds look at few places only. The expansions find the symbols that cover any range of ids, so one
document is decoded without its neighbours (``decode_range``, ``fetch``).

The tokenizer is that of a tokenizers file. Its byte-level split always has a boundary before a space that follows
another character, between a letter and an ASCII character that is none, and between a single line break after a
printable character and a letter. Texts are cut there by Arrow functions; a worker keeps the ids of the distinct parts,
up to a fixed number, and encodes the new parts of a slice together, in one text. Where a text has a space after white
space, or what may be a special token, it goes to the tokenizer as it is.

Defined results. Null text: as an empty text, which is the end id alone. Order: doc_id, nulls first, then text hash;
rows alike in both may swap. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from glyphgate.llm.common import arrow_map, new_path

BLOCK = 1 << 20
#: Places of a frequent pair. With fewer, a rule takes more room than it saves.
LEAST = 4
#: Slots of the table that finds a place's pair.
TABLE_BITS = 20
#: Parts that one worker keeps, bytes of text in a slice, and characters of a text that are encoded at a time.
KEPT, SLICE, LONG = 700_000, 4 << 20, 1 << 20

# Characters that the tokenizer's split takes as white space.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LETTER = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
#: What a text that is cut does not hold; NUL marks the cuts.
_WHOLE = rf"[{_WHITE}] |<\||\x00"
_BEFORE_MARK = rf"([{_LETTER}])([\x01-\x1f!-@\[-`{{-\x7f])"
_BEFORE_LETTER = rf"([!-~]\n)([{_LETTER}])"


def _chunks(text: str) -> list[str]:
    """A text in chunks of about LONG characters, each but the first beginning with a space after another character."""
    out, at = [], 0
    cut = re.compile(r"(?<=\S) ")
    while len(text) - at > LONG and (found := cut.search(text, at + LONG)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.kept: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_joined(self, parts: pa.Array, between: str) -> None:
        """Encode parts as one text: with ``between`` there is a boundary before and after each, so bytes tell them apart."""
        if not len(parts):
            return
        words = parts.to_numpy(zero_copy_only=False).tolist()
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, "<u4")
        sizes = pc.binary_length(parts).to_numpy() + len(between)
        ends, upto = np.cumsum(sizes), np.cumsum(self.width[ids])
        start, stop = np.searchsorted(upto, ends - sizes, "right") * 4, np.searchsorted(upto, ends - len(between)) * 4 + 4
        raw = ids.tobytes()
        self.kept.update(zip(words, [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]))

    def learn(self, parts: pa.Array) -> None:
        """Keep the ids of new parts."""
        if len(self.kept) > KEPT:  # forget the older half; texts to come bring back what is frequent
            for key in list(islice(self.kept, len(self.kept) // 2)):
                del self.kept[key]
        spaced = pc.match_substring_regex(parts, rf"^ [^{_WHITE}]+$")
        bare = pc.match_substring_regex(parts, rf"^[^{_WHITE}]+$")
        self._learn_joined(parts.filter(spaced), "")
        self._learn_joined(parts.filter(bare), "\n")
        other = parts.filter(pc.invert(pc.or_(spaced, bare))).to_pylist()
        self.kept.update(zip(other, self.ids(other)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE)
        cut = pc.replace_substring_regex(pc.if_else(whole, "", texts), _BEFORE_MARK, "\\1\0\\2")
        cut = pc.replace_substring(pc.replace_substring_regex(cut, _BEFORE_LETTER, "\\1\0\\2"), " ", "\0 ")
        parts = pc.split_pattern(cut, "\0")
        coded, offsets = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        pool = list(map(self.kept.get, words))
        new = [i for i, ids in enumerate(pool) if ids is None]
        if new:
            self.learn(coded.dictionary.take(pa.array(new)))
            for i in new:
                pool[i] = self.kept[words[i]]
        which = coded.indices.to_numpy().astype(np.int64)
        asis = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(asis):  # cut, such a text is one empty part
            which[offsets[asis]] = len(pool) + np.arange(len(asis))
            pool += self.ids(texts.take(pa.array(asis)).to_pylist())
        return gathered(*_pooled(pool), which), np.add.reduceat(np.append(_sizes(pool)[which], 0), offsets[:-1])


def _sizes(pool: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, pool), np.int64, len(pool)) // 4


def _pooled(pool: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = _sizes(pool)
    return np.frombuffer(b"".join(pool), "<u4"), np.cumsum(sizes) - sizes, sizes


def gathered(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of ``flat``, given by where they begin and their sizes, one after another."""
    long = sizes.take(which)
    ends = np.cumsum(long)
    return flat.take(np.repeat(begin.take(which) - ends + long, long) + np.arange(ends[-1] if len(ends) else 0))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _every_second(which: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in runs of one pair that overlaps itself (aaa), and which of them win."""
    same = np.flatnonzero((which == before) | (which == after))
    heads = np.flatnonzero(which[same] != before[same])
    size = np.diff(heads, append=len(same))
    ends = same[heads + size - 1]
    wins = (which[same[heads]] > before[same[heads]]) & (which[ends] > after[ends])
    return same, np.repeat(wins, size) & ((np.arange(len(same)) - np.repeat(heads, size)) % 2 == 0)


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alphabet, rules (two columns), expansions and body of one block."""
    there = np.zeros(int(ids.max(initial=0)) + 1, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there).astype(np.uint32)
    body = (np.cumsum(there, dtype=np.uint32) - np.uint32(1)).take(ids)
    n = len(alphabet)
    rules, sizes = [np.empty((0, 2), np.uint32)], [np.ones(n, np.int64)]
    table = np.zeros(1 << TABLE_BITS, np.int32)
    live = None  # places whose pair may be frequent; at first all
    while len(body) > 1 and (live is None or len(live)):
        left, right = (body[:-1], body[1:]) if live is None else (body.take(live), body.take(live + 1))
        half = 16 if n <= 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        spread, cut = kind(0x9E3779B1 if half == 16 else 0x9E3779B97F4A7C15), kind(2 * half - TABLE_BITS)
        keys = left.astype(kind) << kind(half) | right
        ordered = np.sort(keys)
        starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(starts, append=len(ordered))
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        pairs = ordered[starts[good[np.argsort(counts[good], kind="stable")]]]  # a pair's place in this order is its score
        # Of two pairs with one slot the later is found now, the other in a round to come.
        slots = (pairs * spread >> cut).astype(np.intp)
        table[slots] = np.arange(len(pairs), dtype=np.int32)
        which = table.take((keys * spread >> cut).astype(np.intp))
        table[slots] = 0
        hit = np.flatnonzero(pairs.take(which) == keys)
        which, places = which.take(hit), hit if live is None else live.take(hit)
        score = np.full(len(body) + 1, -1, np.int32)
        score[places] = which
        before, after = score.take(places - 1, mode="wrap"), score.take(places + 1)
        wins = (which > before) & (which > after)
        same, second = _every_second(which, before, after)
        wins[same] = second
        at, which = places[wins], which[wins]
        used = np.bincount(which, minlength=len(pairs)) > 1
        at, which = at[used[which]], which[used[which]]
        if not len(at):
            break
        new = np.stack((pairs[used] >> kind(half), pairs[used] & kind((1 << half) - 1)), 1).astype(np.uint32)
        known = np.concatenate(sizes)
        sizes.append(known[new[:, 0]] + known[new[:, 1]])
        rules.append(new)
        body[at] = (np.cumsum(used, dtype=np.uint32) + np.uint32(n - 1)).take(which)
        again, stay = np.zeros(len(body) + 1, bool), np.ones(len(body), bool)
        again[places] = again[at] = again[at - 1] = True
        stay[at + 1] = False
        body, live, n = body[stay], np.flatnonzero(again[:-1][stay][:-1]), n + len(new)
    return alphabet, np.concatenate(rules), np.concatenate(sizes)[len(alphabet) :].astype(np.uint32), body


def expand(alphabet: np.ndarray, rules: np.ndarray, expansions: np.ndarray, body: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for. Each rule is expanded once; rules of one round refer to earlier symbols only."""
    first = len(alphabet)
    sizes = np.concatenate((np.ones(first, np.int64), expansions))
    begin = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), np.uint32)
    flat[:first] = alphabet
    latest, done = rules.max(1, initial=0), 0
    while done < len(rules):
        late = latest[done:] >= first + done
        to = done + int(late.argmax()) if late.any() else len(rules)
        made = gathered(flat, begin, sizes, rules[done:to].reshape(-1))
        flat[begin[first + done] :][: len(made)] = made
        done = to
    return gathered(flat, begin, sizes, body)


def decode_range(alphabet: np.ndarray, rules: np.ndarray, expansions: np.ndarray, body: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a block; only the symbols that cover them are expanded, step by step."""
    first = len(alphabet)
    sizes = np.concatenate((np.ones(first, np.int64), expansions))[body]
    ends = np.cumsum(sizes)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
    skip = start - (ends[a] - sizes[a]) if end > start else 0
    some = body[a:b].astype(np.int64)
    while len(at := np.flatnonzero(some >= first)):
        pair = rules[some[at] - first]
        out = np.repeat(some, np.where(some >= first, 2, 1))
        to = at + np.arange(len(at))
        out[to], out[to + 1] = pair[:, 0], pair[:, 1]
        some = out
    return alphabet[some][skip : skip + end - start]


def pack(alphabet: np.ndarray, rules: np.ndarray, expansions: np.ndarray, body: np.ndarray) -> dict[str, bytes]:
    halves = body.astype("<u4").view("<u2").reshape(-1, 2).T
    return {"alphabet": alphabet.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "expansions": expansions.astype("<u4").tobytes(), "body": halves.tobytes()}


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alphabet, rules, expansions and body of a stored block."""
    low, high = np.frombuffer(row["body"], "<u2").reshape(2, -1)
    body = low.astype(np.int64) | high.astype(np.int64) << 16
    return np.frombuffer(row["alphabet"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["expansions"], "<u4"), body


BINARY = ("alphabet", "rules", "expansions", "body")


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``most`` bytes of text."""
    upto, at = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(float))), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = BLOCK) -> None:
    """Write the blocks of ``docs`` as Parquet under ``path``; the tokenizer file is on every machine."""
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_docs = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = sorted_docs.select(F.spark_partition_id().alias("part"), F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), np.uint32(end_id)
        names, lengths, held, size, before, no = [], [], [], 0, 0, 0

        def full() -> pa.RecordBatch:
            columns = {"part": pa.array([part], pa.int32()), "block": pa.array([no], pa.int32()), "at": pa.array([before], pa.int64())}
            ids = pa.concat_arrays(names)
            columns["doc_ids"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            columns["lengths"] = pa.array([np.concatenate(lengths)], pa.list_(pa.int64()))
            columns |= {k: pa.array([v], pa.binary()) for k, v in pack(*compress(np.concatenate(held))).items()}
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            for rows in _slices(batch, min(SLICE, 4 * block)):
                part = rows.column(0)[0].as_py()
                texts, counts = rows.column(2), np.ones(rows.num_rows, np.int64)
                if (pc.max(pc.binary_length(texts)).as_py() or 0) > LONG:
                    cut = [_chunks(x or "") for x in texts.to_pylist()]
                    counts = np.array(list(map(len, cut)))
                    texts = pa.array([c for chunks in cut for c in chunks], pa.string())
                ids, found = own.encode(texts)
                found = np.add.reduceat(found, np.cumsum(counts) - counts)
                held.append(np.insert(ids, np.cumsum(found), end))
                names.append(rows.column(1))
                lengths.append(found + 1)
                size += len(held[-1])
                if size >= block:
                    yield full()
                    names, lengths, held, size, before, no = [], [], [], 0, before + size, no + 1
        if size:
            yield full()

    kind = dict(docs.dtypes)["doc_id"]
    binary = ", ".join(f"{name} binary" for name in BINARY)
    arrow_map(placed, run, f"part int, block int, at long, doc_ids array<{kind}>, lengths array<long>, {binary}").write.parquet(path)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, tuple]]:
    """doc_ids, lengths and the unpacked grammar of each block."""
    for i in range(batch.num_rows):
        yield batch["doc_ids"][i].values, batch["lengths"][i].values.to_numpy(), unpack({name: batch[name][i].as_py() for name in BINARY})


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    blocks = spark.read.parquet(path)
    # One row for each partition meets on the driver and is sent back; no block is moved.
    ends = blocks.select("part", (F.col("at") + F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    starts, total = [], 0
    for row in sorted(ends.groupBy("part").agg(F.max("n").alias("n")).collect(), key=lambda r: r["part"]):
        starts.append((row["part"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType())]))
    begun = blocks.join(F.broadcast(offsets), "part").select((F.col("part_start") + F.col("at")).alias("start"), "doc_ids", "lengths", *BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, (names, lengths, grammar) in zip(batch["start"].to_pylist(), _rows(batch)):
                ids = memoryview(expand(*grammar).astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([names, pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    return arrow_map(begun, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, wanted: list) -> DataFrame:
    """doc_id and ids of the ``wanted`` documents: of their blocks, only the symbols that cover them are expanded."""
    blocks = spark.read.parquet(path)
    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    some = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast(kind) for x in wanted])))
    names = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, grammar in _rows(batch):
                ends = np.cumsum(lengths)
                hits = [(x, i) for i, x in enumerate(ids.to_pylist()) if x in names]
                found = [decode_range(*grammar, int(ends[i] - lengths[i]), int(ends[i])) for _, i in hits]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hits], ids.type), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return arrow_map(some.select("doc_ids", "lengths", *BINARY), run, f"doc_id {kind}, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write ``docs`` and read them back."""
    path = path or new_path(docs.sparkSession, "grammar")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
