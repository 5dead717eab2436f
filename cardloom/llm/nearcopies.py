"""Near copies of short records: generalised pigeonhole over the word multiset as a bit vector.

A record is the set of its words, a word that comes k times giving k bits. Two records of sizes s >= l and similarity
at least t share o >= t/(1+t) (s+l) bits, so they differ in at most tau = s+l-2o bits. The bits are spread over
partitions, all bits of one word in the same one. If thresholds T_i have sum(T_i + 1) > tau, two such records differ
by at most T_i bits in some partition i.

* All rare words are one partition. Its threshold is the greatest that can still be probed by single words: records
  with r and r' rare bits and no common rare word differ in r + r' bits there, so T = r + r' - 1.
* The common words fall into m partitions with threshold 0 (equal content) or -1 (unused). They only have to cover
  what the rare words leave, tau + 1 - r - r', which is little or nothing for most pairs. The contents are kept apart
  by r', so that each number of rare bits on the other side gets its own allotment of thresholds.

Word and content frequencies of the whole collection, counted in sketches of fixed size, say which words are rare and
which partitions give the fewest candidates. Candidates are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import cut
from .sketches import COUNTS, bit_chunks, chunks, summed, united

#: Similarity as a fraction.
SIMILARITY = (7, 10)
#: Sizes from FIRST * WIDTH**(c-1) to below FIRST * WIDTH**c are class c.
FIRST, WIDTH = 10, 4
#: Buckets of the sketches of words and of partition contents: what the driver and the executors hold of a collection.
WORD_SKETCH, CONTENT_SKETCH, ASKED_BITS, LACKING_BITS = 1 << 19, 1 << 22, 1 << 24, 1 << 22
#: A word is rare if at most this many records, or this share of them, have it.
RARE_RECORDS, RARE_SHARE = 64, 1 / 4096
#: Numbers of rare bits that are told apart; more count as the last.
MOST_RARE, MOST_CLASSES = 64, 16
#: What travels with a row: the parity of the record's bits in so many groups, its size, its rare bits and flags.
PARITY_BITS, COMMON_PARITY_BITS, SIZE_BITS, SIGNATURE_BITS = 64, 32, 14, 44
#: Ids broadcast to leave out copies or to fetch candidates; beyond that number the join is a shuffle.
BROADCAST_IDS = 1_000_000
#: Half hashes broadcast to tell pairs that need whole ones; beyond that number all pairs get them.
AMBIGUOUS = 1_000_000
#: Packed into the signature: its own bits, the rare bits and the size (0 rare bits in a row of a rare word).
RARE_BITS = 6


def words_of(*columns: Column) -> Column:
    """The longest runs of letters and digits in lower case, joined by single blanks; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), r"[^a-z0-9\p{L}\p{N}]+", " "))


def least_overlap(total: np.ndarray | int, similarity: tuple[int, int] = SIMILARITY):
    """The fewest common bits of two records with ``total`` bits together at the given similarity."""
    p, q = similarity
    return -(-p * total // (p + q))


def size_class(size: np.ndarray) -> np.ndarray:
    out = np.zeros(np.shape(size), np.int64)
    bound = FIRST
    while (np.asarray(size) >= bound).any():
        out += np.asarray(size) >= bound
        bound *= WIDTH
    return out


def class_range(c: int) -> tuple[int, int]:
    return (1, FIRST) if c == 0 else (FIRST * WIDTH ** (c - 1), FIRST * WIDTH**c)


def partitions(c: int) -> int:
    """Partitions of common words in class ``c``: enough for nearly all allotments, few enough to be selective."""
    return (6, 16)[c] if c < 2 else 24 << (c - 2)


def rare_step(c: int) -> int:
    """Numbers of rare bits that share an allotment in class ``c``."""
    return 1 if c < 2 else 2 << (c - 2)


def needed(size: int, c: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """tau + 1 for a record of ``size`` against those of class ``c`` that are not larger; 0 if none can match."""
    p, q = similarity
    low, high = class_range(c)
    smaller = np.arange(max(low, -(-p * size // q)), min(high - 1, size) + 1)
    return int((size + smaller - 2 * least_overlap(size + smaller, similarity)).max()) + 1 if len(smaller) else 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """Word multisets of many records, from a list column of word hashes, as arrays sorted by record and word."""

    def __init__(self, lists: pa.Array):
        offsets = np.asarray(lists.offsets)
        self.size = np.diff(offsets).astype(np.int64)
        record = np.repeat(np.arange(len(lists)), self.size)
        word = np.asarray(lists.values)[offsets[0] : offsets[-1]].view(np.uint64)
        order = np.argsort((record.astype(np.uint64) << np.uint64(44)) | (word >> np.uint64(20)))
        word = word[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (record[1:] != record[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(word)))
        nth = np.arange(len(word)) - np.repeat(first, times)
        self.bits = _mix(word + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.bit_record, self.bit_word = record, np.repeat(np.arange(len(first)), times)
        self.record, self.word, self.times = record[first], word[first], times
        self.classes = size_class(self.size)

    def parity(self, groups: int, only: np.ndarray | None = None) -> np.ndarray:
        """The parity of each record's bits (of some words only) in so many groups."""
        out = np.zeros(len(self.size), np.uint64)
        bits, record = (self.bits, self.bit_record) if only is None else (self.bits[only[self.bit_word]], self.bit_record[only[self.bit_word]])
        np.bitwise_xor.at(out, record, np.uint64(1) << (bits % np.uint64(groups)))
        return out

    def rarest(self, record: int, similarity: tuple[int, int]) -> np.ndarray:
        """Bits of a record of which every similar record that is not larger has one: so many that a record without any
        of them has too few bits in common, the rarest first."""
        p, q = similarity
        a, b = np.searchsorted(self.bit_record, [record, record + 1])
        size = b - a
        missed = size - least_overlap(size + -(-p * size // q), similarity)
        return self.bits[a:b][np.argsort(self.count[self.bit_word[a:b]], kind="stable")[: missed + 1]]

    def buckets(self) -> np.ndarray:
        return (self.word % np.uint64(WORD_SKETCH)).astype(np.int64)

    def split(self, counts: np.ndarray, most: int) -> None:
        """Tell rare words (of at most ``most`` on the scale of the counts) from common ones, count each record's rare bits."""
        self.count = counts[self.buckets()]
        self.rare = self.count <= most
        bits = np.bincount(self.record[self.rare], weights=self.times[self.rare], minlength=len(self.size)).astype(np.int64)
        self.rare_bits = np.minimum(bits, MOST_RARE - 1)

    def contents(self, rows: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the common words in every partition of class ``c`` for the given rows, and which are not empty."""
        m = partitions(c)
        place = np.full(len(self.size), -1)
        place[rows] = np.arange(len(rows))
        held = (place[self.record] >= 0) & ~self.rare
        cell = place[self.record[held]] * m + (_mix(self.word[held] ^ np.uint64(c + 77)) % np.uint64(m)).astype(np.int64)
        sums = np.zeros(len(rows) * m, np.uint64)
        np.add.at(sums, cell, _mix(self.word[held] * np.uint64(2 * c + 3) + self.times[held].astype(np.uint64)))
        filled = np.zeros(len(rows) * m, bool)
        filled[cell] = True
        sums = _mix(sums + np.tile(np.arange(m, dtype=np.uint64), len(rows)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c))
        return sums.reshape(len(rows), m), filled.reshape(len(rows), m)


def _with_rare(sums: np.ndarray, rare_bits: np.ndarray | int) -> np.ndarray:
    return _mix(sums + np.asarray(rare_bits).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _batches(batches, column: str, dropped: np.ndarray | None = None):
    """Record batches of a list column without the given ids, cut so that a record's number fits the sort key."""
    for whole in batches:
        for batch in (whole.slice(i, 8192) for i in range(0, whole.num_rows, 8192)):
            if dropped is not None and len(dropped):
                batch = batch.filter(pa.array(~np.isin(np.asarray(batch.column("id")), dropped)))
            yield Batch(batch.column(column)), batch


def _rows(*parts):
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
    return (pa.RecordBatch.from_pandas(part, schema, preserve_index=False) for part in parts)


def _count_words(batches):
    counts, records = np.zeros(WORD_SKETCH, np.int64), np.zeros(1, np.int64)
    for batch, _ in _batches(batches, "words"):
        counts += np.bincount(batch.buckets(), minlength=WORD_SKETCH)
        records += len(batch.size)
    yield from _rows(chunks(counts, 0), chunks(records, 1))


def _count_contents(words, most: int):
    def run(batches):
        counts, held = np.zeros(CONTENT_SKETCH, np.int64), np.zeros((MOST_CLASSES, MOST_RARE), np.int64)
        for batch, _ in _batches(batches, "words"):
            batch.split(words.value, most)
            np.add.at(held, (np.minimum(batch.classes, MOST_CLASSES - 1), batch.rare_bits), 1)
            for c in np.unique(batch.classes):
                rows = np.flatnonzero(batch.classes == c)
                sums, filled = batch.contents(rows, int(c))
                sums = _with_rare(sums, batch.rare_bits[rows][:, None] // rare_step(int(c)))[filled]
                np.add.at(counts, (sums % np.uint64(CONTENT_SKETCH)).astype(np.int64), 1)
        yield from _rows(chunks(counts, 0), chunks(held.ravel(), 1))

    return run


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale in one byte; 0 stays 0."""
    return np.minimum(255, np.ceil(6 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


ONCE = int(scaled(np.ones(1, np.int64))[0])


def allot(costs: np.ndarray, filled: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The partitions with threshold 0 for each row: the allotment of least total cost that reaches ``need``.

    A dynamic program over partitions would carry the least cost of each sum reached so far; as every partition adds
    0 or 1 to that sum, its optimum is the cheapest ``need`` of the filled partitions, which is taken directly.
    """
    ranked = np.where(filled, costs, 256).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    return filled & (ranked < need[:, None])


def _signature_rows(words, most: int, sketch, held: np.ndarray, dropped, similarity: tuple[int, int], asked=None, told=None):
    """Rows (packed signature, id, parity): the contents a record asks for, or, given the bits of what all records ask
    for, those of its own contents that are asked for.

    Two similar records, the larger asking, have a signature in common. Rows of rare words carry the parity of all
    bits; rows of contents that of the common bits, and the number of rare bits, as they are for records without a
    common rare word. A record without enough partitions asks for its rarest bits instead, of which each similar record
    has one; records tell of such bits only if one that lacks partitions asks for them.
    """

    def run(batches):
        counts, table, asking = sketch.value, {}, asked is None
        for batch, source in _batches(batches, "words", dropped.value):
            ids = np.asarray(source.column("id"))
            batch.split(words.value, most)
            size = np.minimum(batch.size, (1 << SIZE_BITS) - 1).astype(np.uint64)
            common = size | (batch.rare_bits.astype(np.uint64) << np.uint64(SIZE_BITS))
            full_parity, common_parity = batch.parity(PARITY_BITS), batch.parity(COMMON_PARITY_BITS, ~batch.rare)
            parts: list[tuple] = []
            lacked: list[np.ndarray] = []

            def out(sums, record, rare=False):
                meta, parity = (size, full_parity) if rare else (common, common_parity)
                parts.append(((sums & np.uint64(-(1 << (64 - SIGNATURE_BITS)) & (1 << 64) - 1)) | meta[record], ids[record], parity[record]))

            several = batch.rare & (batch.count > ONCE)  # a word of one record alone leads to no other
            out(_mix(batch.word[several] + np.uint64(11)), batch.record[several], rare=True)
            if not asking:
                bits = _lacking(batch.bits)
                wanted = _is_set(asked.value[1], bits, LACKING_BITS)
                out(bits[wanted], batch.bit_record[wanted], rare=True)
            for c in range(int(batch.classes.max(initial=0)) + 1):
                step = rare_step(c)
                if not asking:
                    own = np.flatnonzero(batch.classes == c)
                    sums, filled = batch.contents(own, c)
                    contents, record = _with_rare(sums, batch.rare_bits[own][:, None] // step)[filled], own[np.nonzero(filled)[0]]
                    wanted = _is_set(asked.value[0], contents, ASKED_BITS)
                    out(contents[wanted], record[wanted])
                    continue
                rows = np.flatnonzero((batch.classes == c) | (batch.classes == c + 1))
                for s in np.unique(batch.size[rows]).tolist():
                    if (s, c) not in table:
                        table[s, c] = needed(s, c, similarity)
                need = np.array([table[s, c] for s in batch.size[rows].tolist()], np.int64) - batch.rare_bits[rows]
                rows, need = rows[need > 0], need[need > 0]
                if not len(rows):
                    continue
                sums, filled = batch.contents(rows, c)
                full = filled.sum(axis=1)
                lacking = np.zeros(len(rows), bool)
                for fewest in range(0, int(need.max()), step):
                    group = min(fewest, MOST_RARE - 1) // step
                    if not held[min(c, MOST_CLASSES - 1), group * step : (group + 1) * step].any() and group < (MOST_RARE - 1) // step:
                        continue
                    some = need > fewest
                    keyed = _with_rare(sums[some], group)
                    cost = counts[(keyed % np.uint64(CONTENT_SKETCH)).astype(np.int64)].astype(np.int64)
                    short = full[some] < need[some] - fewest
                    lacking[np.flatnonzero(some)[short]] = True
                    # a content that the sketch has never seen has no indexed row, so asking for it would find nothing
                    use = allot(cost, filled[some], need[some] - fewest) & ~short[:, None] & (cost > 0)
                    # and one that was seen once is the record's own where it would be indexed itself
                    own = (batch.classes[rows[some]] == c) & (batch.rare_bits[rows[some]] // step == group)
                    use &= ~(own[:, None] & (cost == ONCE))
                    out(keyed[use], rows[some][np.nonzero(use)[0]])
                for alone in np.unique(rows[lacking]).tolist():
                    bits = _lacking(batch.rarest(alone, similarity))
                    out(bits, np.full(len(bits), alone), rare=True)
                    lacked.append(bits)
            columns = [np.concatenate([part[k] for part in parts]) for k in range(3)]
            if told is not None:
                told(columns[0], lacked)
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["packed", "id", "parity"])

    return run


def _place(sums: np.ndarray, length: int) -> np.ndarray:
    return ((sums >> np.uint64(64 - SIGNATURE_BITS)) % np.uint64(length)).astype(np.int64)


def _is_set(bits: np.ndarray, sums: np.ndarray, length: int) -> np.ndarray:
    at = _place(sums, length)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _lacking(bits: np.ndarray) -> np.ndarray:
    """The signatures of bits that stand for records without enough partitions."""
    return _mix(bits + np.uint64(23))


def _asked_bits(*settings):
    """The bits of all that the records of a task ask for, and of what those without enough partitions ask for."""

    def run(batches):
        bits, lacking = np.zeros(ASKED_BITS, bool), np.zeros(LACKING_BITS, bool)

        def told(packed: np.ndarray, lacked: list[np.ndarray]) -> None:
            bits[_place(packed, ASKED_BITS)] = True
            for sums in lacked:
                lacking[_place(sums, LACKING_BITS)] = True

        for _ in _signature_rows(*settings, told=told)(batches):
            pass
        yield from _rows(bit_chunks(bits), bit_chunks(lacking, 1))

    return run


def _bits_of_pairs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    batch = Batch(lists)
    return _mix(batch.bits + batch.bit_record.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), batch.bit_record


def similar_pairs(first: pa.Array, second: pa.Array, similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs of word lists reach the similarity, exactly."""
    p, q = similarity
    (a, of), (b, _) = _bits_of_pairs(first), _bits_of_pairs(second)
    common = np.bincount(of[np.isin(a, b)], minlength=len(first))
    total = np.diff(np.asarray(first.offsets)) + np.diff(np.asarray(second.offsets))
    return (q * common >= p * (total - common)) & (common > 0)


def _spread(lists: pa.Array) -> pa.Array:
    """Half hashes as whole ones, with their information in the upper bits that records are sorted by."""
    values = np.asarray(lists.values).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return pa.ListArray.from_arrays(lists.offsets, pa.array(values.view(np.int64)))


def _similar(similarity: tuple[int, int], ambiguous):
    """Pairs that reach the similarity by half hashes, and whether the half hashes leave no doubt: none of the first
    record's stands for two words of the candidates."""

    def run(batches):
        doubtful = ambiguous.value
        for whole in batches:
            for batch in (whole.slice(i, 8192) for i in range(0, whole.num_rows, 8192)):
                keep = similar_pairs(_spread(batch.column(2)), _spread(batch.column(3)), similarity)
                kept = batch.filter(pa.array(keep))
                if doubtful is None:
                    sure = np.zeros(kept.num_rows, bool)
                else:
                    lists = kept.column(2)
                    hit = np.isin(np.asarray(lists.values)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()], doubtful)
                    counts = np.concatenate(([0], np.cumsum(hit)))
                    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                    sure = counts[offsets[1:]] == counts[offsets[:-1]]
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(sure)], names=["a", "b", "sure"])

    return run


def _exactly(similarity: tuple[int, int]):
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 8192) for i in range(0, whole.num_rows, 8192)):
                yield batch.select([0, 1]).filter(pa.array(similar_pairs(batch.column(2), batch.column(3), similarity)))

    return run


def keyed_words(records: DataFrame, texts: list[str], id_: str = "id") -> DataFrame:
    """``id``, the hashes of the words in order, and two hashes of the whole, for every record that has words."""
    text = words_of(*[F.col(t) for t in texts])
    held = records.select(F.col(id_).cast("long").alias("id"), text.alias("text")).where(F.col("id").isNotNull() & (F.col("text") != ""))
    words = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    return held.select("id", words.alias("words"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))


def near_copies(records: DataFrame, texts: list[str], similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b`` of class representatives with at least the given similarity, and the membership ``id, rep``.

    Records with the same words in the same order form a class with its smallest id. Null texts count as empty;
    records without any word are similar to nothing and in no class. Exact repeats of a row count once. Only ``id``
    and the text columns are read.
    """
    context = records.sparkSession.sparkContext
    # kept by the executors for the passes below; what is lost with one of them is computed again
    keyed = keyed_words(records, texts).persist(StorageLevel.MEMORY_AND_DISK)
    # all words and contents are counted; each executor keeps its own copy of a broadcast on disk: a byte a bucket serves
    counted = summed(keyed.select("words").mapInArrow(_count_words, COUNTS), lambda kind, x: x if kind else scaled(x))
    most = int(scaled(np.array([max(RARE_RECORDS, int(counted[1][0] * RARE_SHARE)) if counted else 0]))[0])
    words = context.broadcast(counted.get(0, np.zeros(WORD_SKETCH, np.uint8)))
    counted = summed(keyed.select("words").mapInArrow(_count_contents(words, most), COUNTS), lambda kind, x: x if kind else scaled(x))
    sketch = context.broadcast(counted.get(0, np.zeros(CONTENT_SKETCH, np.uint8)))
    held = counted[1].reshape(MOST_CLASSES, MOST_RARE) if counted else np.zeros((MOST_CLASSES, MOST_RARE), np.int64)

    # only classes of several records need a list of members; all other records stand for themselves
    several = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("k1", "k2", "rep")
    members = cut(keyed.select("id", "k1", "k2").join(several, ["k1", "k2"]).select("id", "rep").distinct())
    copies = members.where("id <> rep").select("id")
    reps = keyed.select("id", "words")
    if copies.count() <= BROADCAST_IDS:
        dropped = context.broadcast(copies.toPandas()["id"].to_numpy(np.int64))
    else:
        dropped = context.broadcast(np.zeros(0, np.int64))
        reps = reps.join(copies, "id", "left_anti")

    settings = (words, most, sketch, held, dropped, similarity)
    wanted = context.broadcast(united(reps.mapInArrow(_asked_bits(*settings), COUNTS), [ASKED_BITS, LACKING_BITS]))

    def rows(names: list[str], *more) -> DataFrame:
        return reps.mapInArrow(_signature_rows(*settings, *more), "packed long, id long, parity long").toDF(*names)

    p, q = similarity
    size_mask, meta_bits = F.lit((1 << SIZE_BITS) - 1), 64 - SIGNATURE_BITS
    size_a, size_b = F.col("x").bitwiseAND(size_mask), F.col("y").bitwiseAND(size_mask)
    up = (size_a + size_b) * p + (p + q - 1)
    tau = size_a + size_b - 2 * ((up - F.pmod(up, F.lit(p + q))) / (p + q)).cast("long")
    rare = F.shiftright(F.col("x"), SIZE_BITS).bitwiseAND(F.lit((1 << RARE_BITS) - 1)) + F.shiftright(F.col("y"), SIZE_BITS).bitwiseAND(F.lit((1 << RARE_BITS) - 1))
    near = (F.bit_count(F.col("px").bitwiseXOR(F.col("py"))) <= tau - rare) | (size_a == size_mask)
    smaller = (size_b < size_a) | ((size_b == size_a) & ((F.col("b") < F.col("a")) | (size_a == size_mask) & (F.col("b") != F.col("a"))))
    # a sort-merge join: the rows outgrow any size that is estimated from the texts
    asked, indexed = rows(["x", "a", "px"]), rows(["y", "b", "py"], wanted)
    same = F.shiftright(F.col("x"), meta_bits) == F.shiftright(F.col("y"), meta_bits)
    found = asked.hint("merge").join(indexed, same & near & smaller & (size_b * q >= size_a * p))
    candidates = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = cut(_verified(candidates, keyed.select("id", "words"), similarity).distinct())
    keyed.unpersist()
    return pairs, members


def _verified(candidates: DataFrame, texts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The candidates that reach the similarity, exactly on the hashes of whole words.

    Most pairs are decided by half hashes, which are half the data to move: two words with one half hash make a pair more
    similar, never less, so none is lost; and where no half hash of a pair stands for two words of all candidates it
    is as good as the whole. The other pairs that seem similar are compared by whole hashes.
    """
    context = texts.sparkSession.sparkContext
    half = lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    def of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    held = of(candidates)
    spoken = held.select(F.explode("words").alias("w")).groupBy(half(F.col("w")).alias("h")).agg(F.min("w").alias("low"), F.max("w").alias("high"))
    doubtful = cut(spoken.where("low < high").select("h"))
    few = doubtful.count() <= AMBIGUOUS
    ambiguous = context.broadcast(doubtful.toPandas()["h"].to_numpy(np.int32) if few else None)

    def joined(pairs: DataFrame, records: DataFrame, form) -> DataFrame:
        formed = records.withColumn("words", F.transform("words", form))
        with_a = pairs.join(formed.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a")
        return with_a.join(formed.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b").select("a", "b", "words_a", "words_b")

    seeming = cut(joined(candidates, held, half).mapInArrow(_similar(similarity, ambiguous), "a long, b long, sure boolean"))
    sure, unsure = seeming.where("sure").select("a", "b"), seeming.where("not sure").select("a", "b")
    if unsure.isEmpty():
        return sure
    return sure.unionByName(joined(unsure.distinct(), of(unsure), lambda w: w).mapInArrow(_exactly(similarity), "a long, b long"))


def near_copy_pairs(records: DataFrame, texts: list[str], similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Every pair of different records with at least the given similarity: ``id_a < id_b``, copies included."""
    pairs, members = near_copies(records, texts, similarity)
    within = members.select("rep", F.col("id").alias("x")).join(members.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    of_a, of_b = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = pairs.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_copy_groups(records: DataFrame, texts: list[str], similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per record with words: its class (smallest id with the same words), the class's size and the number of
    records outside the class that are similar to it. No pairs of copies are made."""
    pairs, members = near_copies(records, texts, similarity)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weighed = ends.join(sizes.select(F.col("rep").alias("b"), "n_copies"), "b", "left")
    links = weighed.groupBy(F.col("a").alias("class_id")).agg(F.sum(F.coalesce("n_copies", F.lit(1))).alias("n_links"))
    everyone = keyed_words(records, texts).select("id").distinct().join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    per_class = everyone.join(sizes.withColumnRenamed("rep", "class_id"), "class_id", "left").join(links, "class_id", "left")
    return per_class.select("id", "class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
