"""Collocations: phrases of two or three words that occur together far more often than their parts would let expect.

Counting. A task keeps the phrases that it has seen in a HAT-trie: for each language a branch by the first word's id, and
below it containers, which are hash tables from the word ids of a phrase to its count, in arrays of numbers (12 bytes a
slot) and not as Python objects, so that two tasks fit beside an executor's heap. Neighbouring words share a (hybrid)
container. One of over ``BURST`` phrases bursts: a word that has half of it gets a (pure) container of its own, one level
down, else two halves of the words get one each. So the trie stays shallow and only frequent words have branches. Beyond
``ENTRIES`` phrases a task spills its largest subtrees, whole and sorted, as runs of rows. The runs of all tasks are dealt out
by language and prefix, which is the first two words (no single one, however common, meets in one task), and merged there.
The prefix is no column of a run, as the rows that a task writes are held in the executor's heap.

Texts are split once, into written blocks that hold their own words and the places of these as numbers; the three counts
read the blocks, so a word is looked up once for each block and not wherever it stands.

A phrase occurs no more often than its parts. So words are counted first, then pairs of words that are frequent, then
triples of pairs that are frequent (``LEAST`` times or more in a language). What is frequent goes to the tasks as a table
of bits by hash, in which each frequent word or pair sets ``PROBES`` of 8 bits for each or more, but of ``BITS`` at most (32 MB);
others may find all theirs set, so that a task may count what turns out to be rare, and the sums decide. Nothing frequent is ever left out.

Defined results. Null text: empty. Null lang: ``und``. Without words: no rows. Repeated rows: each counts. Words and texts of
any length count whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import arrow_map, discard, materialize, number_within, records_per_batch

#: Occurrences of a candidate.
LEAST = 10
#: Phrases that a language's list has, and the share (of 100) of a phrase's occurrences that makes a longer one replace it.
TOP, SHARE = 2000, 50
#: Phrases of a container before it bursts, phrases and words that a task holds, words of a block.
BURST, ENTRIES, WORDS, BLOCK = 1 << 16, 1_000_000, 300_000, 1 << 18
#: Texts that go to Python at a time.
TEXTS = 200
#: Words counted before all is spilled, so that 32 bits hold every count of a task.
COUNTED = 1 << 31
#: Languages of which a task keeps unfinished blocks.
LANGUAGES = 64
#: Most bits of a table of what is frequent, as a power of two, and bits that each word or pair sets.
BITS, PROBES = 28, 4
#: Bits of a word id within a packed phrase.
WIDE = 21

# Ends of pieces become a byte that no text holds, A-Z become a-z.
_MARK = b"\xff"
_BYTES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d" + bytes(range(65, 91)), _MARK * 10 + bytes(range(97, 123)))
_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_BLOCK = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary())), ("ids", pa.list_(pa.int32()))])


def split(text: bytes) -> list[bytes]:
    """The words of a text, with a mark wherever a piece ends."""
    return text.translate(_BYTES).replace(_MARK, b" \xff ").split()


class Container:
    """A hash table from packed phrases of ``length`` word ids to counts; a pure one belongs to one first word, which its keys leave out."""

    __slots__ = ("counts", "keys", "length", "size", "word")

    def __init__(self, length: int, word: int | None = None) -> None:
        self.length, self.word = length, word
        self.clear()

    def __len__(self) -> int:
        return self.size

    def clear(self, slots: int = 64) -> None:
        self.size, self.keys, self.counts = 0, np.zeros(slots, np.int64), np.zeros(slots, np.uint32)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys, none of them 0, and their counts."""
        if 3 * (self.size + len(keys)) > 2 * len(self.keys):
            held = self.keys > 0
            old = self.keys[held], self.counts[held]
            self.clear(1 << (3 * (len(old[0]) + len(keys)) // 2).bit_length())
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        last = len(self.keys) - 1
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - last.bit_length())).view(np.int64)
        step = 0
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # where several want one slot, one of them gets it
            mine = self.keys[at] == keys
            self.counts[at[mine]] += counts[mine].astype(np.uint32)
            self.size += int(np.count_nonzero(mine & free))
            step += 1
            rest = ~mine
            keys, counts, at = keys[rest], counts[rest], (at[rest] + step) & last

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, with the first word, and their counts."""
        held = np.flatnonzero(self.keys)
        keys, counts = self.keys[held], self.counts[held]
        order = np.argsort(keys)
        return keys[order] + ((self.word or 0) << WIDE * self.length), counts[order].astype(np.int64)


class Trie:
    """Counts of packed phrases of one language: containers for ranges of first words, in order."""

    def __init__(self, length: int) -> None:
        self.length, self.low, self.containers = length, [0], [Container(length)]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys, in order, and how often each was seen."""
        shift = WIDE * (self.length - 1)
        ends = [*np.searchsorted(keys, np.array(self.low[1:], np.int64) << shift).tolist(), len(keys)]
        full, a = [], 0
        for at, (container, b) in enumerate(zip(self.containers, ends)):
            if b > a:
                some = keys[a:b] - (container.word << shift) if container.word is not None else keys[a:b]
                container.add(some, counts[a:b])
                if len(container) > BURST and container.word is None and self.length > 1:
                    full.append(at)
            a = b
        for at in reversed(full):
            self._burst(at)

    def _burst(self, at: int) -> None:
        """Replace a container by one for its commonest first word, if that has half of it, or else by two halves."""
        keys, counts = self.containers[at].items()
        shift = WIDE * (self.length - 1)
        first = keys >> shift
        middle = int(first[len(first) // 2])
        a, b = np.searchsorted(first, [middle, middle + 1]).tolist()
        if 2 * (b - a) >= len(first):
            parts = [(None, self.low[at], 0, a), (middle, middle, a, b), (None, middle + 1, b, len(first))]
        else:  # the middle word goes with the half that is smaller
            cut, word = (a, middle) if a >= len(first) - b else (b, middle + 1)
            parts = [(None, self.low[at], 0, cut), (None, word, cut, len(first))]
        made = []
        for word, low, x, y in parts:
            child = Container(self.length if word is None else self.length - 1, word)
            child.add(keys[x:y] - ((word or 0) << shift), counts[x:y])
            made.append((low, child))
        made = [m for k, m in enumerate(made) if k + 1 == len(made) or m[0] < made[k + 1][0]]  # ranges that hold a word
        self.low[at : at + 1], self.containers[at : at + 1] = [low for low, _ in made], [child for _, child in made]

    def __len__(self) -> int:
        return sum(map(len, self.containers))


class _Vocabulary(dict):
    """Word ids of a language from 1; 0 for the end of a piece and for words that are not frequent, which are not kept."""

    def __init__(self, lang: str, frequent: np.ndarray | None) -> None:
        super().__init__({_MARK: 0})
        self.words, self.hashes = [b""], array("Q", [0])
        self.start, self.frequent = lang.encode() + b" ", frequent

    def __missing__(self, word: bytes) -> int:
        return self.of([word])[0]

    def of(self, words: list[bytes]) -> list[int]:
        """The ids of words; new ones that are frequent get the next."""
        fresh = [w for w in words if w not in self]
        if self.frequent is not None and fresh:
            codes = np.fromiter((xxhash.xxh64_intdigest(self.start + w, 42) for w in fresh), np.uint64, len(fresh))
            some = _holds(self.frequent, codes)
            fresh = list(compress(fresh, some.tolist()))
            self.hashes.frombytes(codes[some].tobytes())
        self.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))
        self.words += fresh
        return [self.get(w, 0) for w in words]


def _holds(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each of many hashes whether the table of bits holds it."""
    last = len(bits) * 8 - 1
    out, by = np.ones(len(code), bool), code >> np.uint64(32) | np.uint64(1)
    for k in range(PROBES):
        at = (code + np.uint64(k) * by) & np.uint64(last)
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from those of the words."""
    return a ^ (b << np.uint64(1) | b >> np.uint64(63))


class Counter:
    """One task's counts of the phrases of ``length`` words."""

    def __init__(self, length: int, words: np.ndarray | None, pairs: np.ndarray | None) -> None:
        self.length, self.frequent, self.pairs = length, words, pairs
        self.tries: dict[str, Trie] = {}
        self.known: dict[str, _Vocabulary] = {}
        self.seen = 0

    def add(self, lang: str, words: list[bytes], places: np.ndarray) -> None:
        """Put the phrases of a block into the trie of its language."""
        if lang not in self.known:
            self.known[lang] = _Vocabulary(lang, self.frequent)
        known = self.known[lang]
        ids = np.array(known.of(words), np.int64)[places]
        self.seen += len(ids)
        n = len(ids) - self.length + 1
        if n <= 0:
            return
        whole, keys = np.ones(n, bool), np.zeros(n, np.int64)
        for k in range(self.length):
            whole &= ids[k : n + k] > 0
            keys = keys << WIDE | ids[k : n + k]
        if self.pairs is not None:
            codes = np.array(known.hashes, np.uint64)[ids]
            for k in range(self.length - 1):
                whole &= _holds(self.pairs, _paired(codes[k : n + k], codes[k + 1 : n + k + 1]))
        found = np.unique(keys[whole], return_counts=True)
        if len(found[0]):
            self.tries.setdefault(lang, Trie(self.length)).add(*found)

    def _run(self, lang: str, words: pa.Array, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        mask = (1 << WIDE) - 1
        for at in range(0, len(keys), 1 << 16):
            some = keys[at : at + (1 << 16)]
            parts = [words.take(pa.array(some >> WIDE * k & mask)) for k in range(self.length - 1, -1, -1)]
            phrase = (pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), phrase, pa.array(counts[at : at + (1 << 16)])], schema=_RUN)

    def spill(self, most: int) -> Iterator[pa.RecordBatch]:
        """Give out whole subtrees, the largest first, until ``most`` phrases are left."""
        whole = [(len(c), lang, at) for lang, trie in self.tries.items() for at, c in enumerate(trie.containers)]
        total = sum(n for n, *_ in whole)
        going: dict[str, list[int]] = {}
        for n, lang, at in sorted(whole, key=lambda s: -s[0]):
            if total <= most:
                break
            going.setdefault(lang, []).append(at)
            total -= n
        for lang, places in going.items():
            held, words = self.tries[lang].containers, pa.array(self.known[lang].words, pa.binary())
            for at in sorted(places):
                found = held[at].items()
                held[at].clear()
                yield from self._run(lang, words, *found)

    def eased(self) -> Iterator[pa.RecordBatch]:
        """Spill what goes beyond the bounds of phrases, words and counts."""
        if self.seen >= COUNTED:
            yield from self.spill(0)
            self.seen = 0
        if sum(map(len, self.tries.values())) > ENTRIES:
            yield from self.spill(ENTRIES // 2)
        if sum(len(v.words) for v in self.known.values()) > WORDS:
            yield from self.spill(0)
            self.known = {}


def blocks(docs: DataFrame) -> DataFrame:
    """lang, words and ids of blocks: about ``BLOCK`` words of texts of a language, each as its place in ``words``; the mark is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def full(lang: str) -> pa.RecordBatch:
            known, parts, _ = held.pop(lang)
            ids = np.concatenate(parts)
            columns = [pa.array([lang], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(list(known), pa.binary()))]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], schema=_BLOCK)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split(text.as_py())
                words.append(_MARK)
                if lang not in held:
                    known = held[lang] = (_Numbers({_MARK: 0}), [], [0])
                known, parts, size = held[lang]
                parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size[0] += len(words)
                if size[0] >= BLOCK:
                    yield full(lang)
                elif len(held) > LANGUAGES:
                    yield full(next(iter(held)))
        for lang in list(held):
            yield full(lang)

    texts = docs.where("text IS NOT NULL").select(language(), F.col("text").cast("binary").alias("text"))
    return arrow_map(texts, run, "lang string, words array<binary>, ids array<int>")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = no = len(self)
        return no


def counted(found: DataFrame, length: int, least: int, words: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """lang, phrase and f, ``least`` or more, of the phrases of ``length`` words in blocks, in which all words, and all neighbours, are frequent."""
    frequent, joined = bit_table(words), bit_table(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(length, frequent and np.frombuffer(frequent.value, np.uint8), joined and np.frombuffer(joined.value, np.uint8))
        for batch in batches:
            for lang, held, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own.add(lang, held.values.to_pylist(), ids.values.to_numpy())
                yield from own.eased()
        yield from own.spill(0)

    # A block is a megabyte or two: without this all those of a task would be read at once, and go to Python as one batch, held by the JVM, off its heap, and by Python.
    with records_per_batch(found.sparkSession, 2):
        runs = arrow_map(found, run, "lang string, phrase string, f long")
        prefix = F.substring_index("phrase", " ", 2) if length > 2 else F.col("phrase")
        merged = runs.repartition("lang", prefix).groupBy("lang", prefix.alias("prefix"), "phrase").agg(F.sum("f").alias("f"))
        return materialize(merged.where(F.col("f") >= least).drop("prefix"), "phrases")


def language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")


def bit_table(found: DataFrame | None):
    """A broadcast table of bits by hash of (lang, phrase), in which those of ``found`` are set."""
    if found is None:
        return None
    count = found.count()
    bits = min(BITS, max(18, (8 * count - 1).bit_length()))
    codes = [F.xxhash64(F.concat("lang", F.lit(" "), F.get(F.split("phrase", " "), F.lit(k)))) for k in (0, 1)]
    turned = F.shiftleft(codes[1], 1).bitwiseOR(F.shiftrightunsigned(codes[1], 63))
    code = F.when(F.instr("phrase", " ") > 0, codes[0].bitwiseXOR(turned)).otherwise(codes[0])
    last, by = F.lit((1 << bits) - 1), F.shiftrightunsigned("code", 32).bitwiseOR(F.lit(1))
    places = [(F.col("code").bitwiseAND(last) + k * by).bitwiseAND(last) for k in range(PROBES)]
    at = found.select(code.alias("code")).select(F.explode(F.array(*places)).alias("at"))
    # Chunks of 32,768 bits: 4 KB each, and 32 MB in all at most.
    chunks = at.groupBy(F.shiftright("at", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).collect()
    out = bytearray(1 << bits - 3)
    for row in chunks:
        out[row["chunk"] << 12 : (row["chunk"] << 12) + 4096] = row["bits"]
    return found.sparkSession.sparkContext.broadcast(bytes(out))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: products fit 38 digits while counts have 15."""
    wide = lambda c: c.cast("decimal(15,0)")
    top = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    with records_per_batch(docs.sparkSession, TEXTS):  # not all texts of a task at once
        texts = materialize(blocks(docs), "blocks")
    everything = counted(texts, 1, 1)
    totals = everything.groupBy("lang").agg(F.sum("f").alias("n"))
    words = everything.where(F.col("f") >= least)
    pairs = counted(texts, 2, least, words)
    triples = counted(texts, 3, least, words, pairs)
    discard(texts)

    def part(*at: int) -> Column:
        return F.array_join(F.slice(F.split("phrase", " "), at[0] + 1, len(at)), " ")

    def looked_up(found: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
        right = table.select("lang", F.col("phrase").alias("__part"), F.col("f").alias(name))
        return found.withColumn("__part", key).join(right, ["lang", "__part"]).drop("__part")

    two = looked_up(looked_up(pairs.withColumnRenamed("f", "a"), words, part(0), "l"), words, part(1), "r").withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    three = triples.withColumnRenamed("f", "a")
    for table, at, name in ((words, (0,), "l1"), (pairs, (1, 2), "r1"), (pairs, (0, 1), "l2"), (words, (2,), "r2")):
        three = looked_up(three, table, part(*at), name)
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.withColumn("cut", F.least(*cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inside = triples.select("lang", F.explode(F.array(part(0, 1), part(1, 2))).alias("phrase"), F.col("f").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))
    two = two.join(inside, ["lang", "phrase"], "left").where(alone).drop("longer")
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    found = two.select(*columns).unionByName(three.select(*columns))
    ranked, _ = number_within(found, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "place", "found")
    best = ranked.where(F.col("place") < top).join(totals, "lang")
    return best.select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
