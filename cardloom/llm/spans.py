"""Long exact spans shared between records: sharded full-text indexes and documents streamed against them.

1. Every text gives sampled hashes of its 64-grams such that any run of ``least`` characters holds at least one that
   both texts of a shared run choose. Hashes that only one text has are dropped: texts without partners end here.
2. The stretches around the remaining hashes are indexed once, in shards of bounded size. A document is streamed
   against those shards only that hold one of its hashes. Exact copies of a text are represented by one of them.
3. Backward search finds aligned blocks of the streamed stretches in the shard; the matches are extended to both
   sides and those of at least ``least`` characters are reported.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .fmindex import FMIndex

LEAST = 200  #: characters of the shortest span reported
GRAM = 64  #: characters of a sampled hash
HOT = 256  #: rows from which a hash is replaced by those of longer stretches
HOT_HASHES = 1_000_000  #: hot hashes that are broadcast; beyond that number all hashes are replaced
PARTS = 8  #: stretches that take the place of a hot gram
SHARD_CHARS = 1 << 20  #: characters aimed at in the index of one shard
QUERY_BLOCK = 4096  #: documents streamed against one copy of a shard
_LOW = (1 << 21) - 1
_STRETCH = 1 << 20  #: longer texts are hashed in overlapping stretches of this length


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_UP = _powers(_STRETCH * 2 + 1, _BASE)
_DOWN = _powers(_STRETCH * 2 + 1, pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, longer: bool = False, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the sampled grams of several texts lying one after another in ``codes``.

    Of all grams within any ``least`` characters of one text the one with the smallest hash (the last of equal ones)
    is chosen, so the choice depends on those characters only. With ``longer`` grams (of the hashes ``hot``, or all) are
    told by hashes of longer stretches around them: a shared run of ``least`` characters that holds the gram goes on for PARTS
    blocks less one to its left and right together, so it holds one of the PARTS stretches of so many blocks.
    """
    n, width = len(codes) - GRAM + 1, least - GRAM + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * _UP[: len(codes)])))
    hashes = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n])
    key = (hashes & np.uint64(~_LOW & (1 << 64) - 1)) | (np.uint64(_LOW) - np.arange(n, dtype=np.uint64))
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])
    inside = np.zeros(len(smallest) + 1, np.int64)
    held = ends - starts >= least
    np.add.at(inside, starts[held], 1)
    np.add.at(inside, ends[held] - least + 1, -1)
    chosen = smallest[np.cumsum(inside[:-1]) > 0]
    at = (np.uint64(_LOW) - (chosen & np.uint64(_LOW))).astype(np.int64)
    at = np.unique(at)
    if not longer:
        return at, hashes[at].view(np.int64)
    if hot is not None:
        at = at[np.isin(hashes[at].view(np.int64), hot)]
    step, text = (least - GRAM) // PARTS, np.searchsorted(ends, at, side="right")
    places, keys = [], []
    for left in range(PARTS):
        a, b = at - left * step, at + GRAM + (PARTS - 1 - left) * step
        inside = (a >= starts[text]) & (b <= ends[text])
        a, b = a[inside], b[inside]
        places.append(at[inside])
        keys.append(_mixed(_mixed((sums[b] - sums[a]) * _DOWN[a]) + np.uint64(left + 1)).view(np.int64))
    return np.concatenate(places), np.concatenate(keys)


def _stretches(ids, keys, texts, least: int):
    """Groups of texts (or overlapping stretches of long ones) of up to 2^20 characters: (ids, keys, offsets, codes)."""
    group, size = [], 0
    for i, k, text in zip(ids, keys, texts):
        codes = _codes(text)
        for begin in range(0, max(1, len(codes) - least + 1), _STRETCH - least + 1):
            part = codes[begin : begin + _STRETCH]
            if size + len(part) > _STRETCH * 2 - 1:
                yield group
                group, size = [], 0
            group.append((i, k, begin, part))
            size += len(part)
            if size >= _STRETCH // 2:
                yield group
                group, size = [], 0
    if group:
        yield group


def _anchor_rows(least: int, hot=None):
    def run(batches):
        for pdf in batches:
            for group in _stretches(pdf["doc_id"], pdf["k1"], pdf["text"], least):
                sizes = np.array([len(p) for *_, p in group])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                at, hashes = anchors(np.concatenate([p for *_, p in group]), starts, ends, least, hot is not None, hot and hot.value)
                which = np.searchsorted(ends, at, side="right")
                offsets = np.array([b for _, _, b, _ in group]) - starts
                yield pd.DataFrame({
                    "hash": hashes, "doc_id": np.array([g[0] for g in group], np.int64)[which],
                    "k1": np.array([g[1] for g in group], np.int64)[which], "pos": (at + offsets[which]).astype(np.int32),
                })

    return run


def _segments(positions: list[int], n: int, least: int) -> list[tuple[int, int]]:
    """The stretches of a text of ``n`` characters that can hold a run with one of the given grams."""
    out: list[list[int]] = []
    for p in sorted(positions):
        a, b = max(0, p - (least - GRAM)), min(n, p + least)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _send(least: int):
    """Rows for the shards: role 0 goes into the index, role 1 is streamed against it."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text, positions, own, copies, routes in zip(pdf["doc_id"], pdf["text"], pdf["positions"], pdf["own"], pdf["own_salts"], pdf["routes"]):
                for a, b in _segments(list(positions), len(text), least):
                    part = text[a:b]
                    rows += [(own, salt, 0, doc, a, part) for salt in range(copies)]
                    rows += [(r["shard"], r["salt"], 1, doc, a, part) for r in routes]
            yield pd.DataFrame(rows, columns=["shard", "salt", "role", "doc_id", "begin", "part"])

    return run


class _Shard:
    """The index of one shard and the search of streamed stretches in it."""

    def __init__(self, docs: list[int], parts: list[str], least: int):
        self.least, self.block = least, least // 2
        codes = [_codes(p) for p in parts]
        self.symbols = np.unique(np.concatenate(codes))
        sizes = np.array([len(c) + 1 for c in codes])
        self.begins = np.cumsum(sizes) - sizes
        self.docs = np.array(docs, np.int64)
        self.text = np.zeros(int(sizes.sum()), np.int32)
        for at, c in zip(self.begins, codes):
            self.text[at : at + len(c)] = np.searchsorted(self.symbols, c) + 1
        self.index = FMIndex(self.text)

    def matches(self, docs: np.ndarray, begins: np.ndarray, parts: list[str], at_once: int = 200_000):
        """Yields arrays (streamed document, indexed document, start, end in the streamed text) of long matches."""
        b = self.block
        codes = [_codes(p) for p in parts]
        sizes = np.array([len(c) + 2 * b for c in codes])
        text = np.full(int(sizes.sum()) + b, -1, np.int32)
        offsets = np.cumsum(sizes) - sizes + b
        for at, c in zip(offsets, codes):
            near = np.minimum(np.searchsorted(self.symbols, c), len(self.symbols) - 1)
            text[at : at + len(c)] = np.where(self.symbols[near] == c, near + 1, -1)
        # blocks lie at multiples of their length in the whole document; any run of `least` holds one
        part, place = [], []
        for k, (begin, c) in enumerate(zip(begins, codes)):
            first = -begin % b
            where = np.arange(first, len(c) - b + 1, b)
            part.append(np.full(len(where), k))
            place.append(where)
        part, place = np.concatenate(part), np.concatenate(place)
        starts = offsets[part] + place
        low, high = self.index.search(text[starts[:, None] + np.arange(b)])
        found = np.flatnonzero(high > low)
        edge = np.searchsorted(np.cumsum(high[found] - low[found]), np.arange(0, int((high - low)[found].sum()) + 1, at_once), side="right")
        padded = np.concatenate((np.zeros(b, np.int32), self.text, np.zeros(b, np.int32)))
        for x, y in zip(edge, [*edge[1:], len(found)]):
            rows = found[x:y]
            if not len(rows):
                continue
            there, row = self.index.locate(low[rows], high[rows])
            row = rows[row]
            indexed = self.docs[np.searchsorted(self.begins, there, side="right") - 1]
            streamed = docs[part[row]]
            other = indexed != streamed
            there, row, indexed, streamed = there[other], row[other], indexed[other], streamed[other]
            at = starts[row]
            # the separators (0 there, -1 here) end every extension
            left = self._equal(text, at, padded, there + b, -1)
            right = self._equal(text, at + b - 1, padded, there + b + b - 1, 1)
            long = left + b + right >= self.least
            start = begins[part[row]] + place[row]
            yield streamed[long], indexed[long], (start - left)[long], (start + b + right)[long]

    def _equal(self, text, at, padded, there, way: int) -> np.ndarray:
        step = way * np.arange(1, self.block + 1)
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 20_000):
            same = text[at[i : i + 20_000, None] + step] == padded[there[i : i + 20_000, None] + step]
            out[i : i + 20_000] = np.where(same.all(axis=1), self.block, np.argmin(same, axis=1))
        return out


def _search(least: int, pairs_wanted: bool):
    """Streams the sorted rows of a partition: a shard's index rows come first, then its streamed rows in batches. Tells
    either the pairs or what each text shares."""

    def answer(shard, rows):
        for a, b, start, end in shard.matches(rows["doc_id"].to_numpy(), rows["begin"].to_numpy(), rows["part"].tolist()):
            if len(a) and pairs_wanted:
                pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                yield pd.DataFrame({"doc_a": pairs[:, 0], "doc_b": pairs[:, 1], "start": np.int64(-1), "end": np.int64(-1)})
            elif len(a):
                cover = pd.DataFrame({"doc_a": a, "block": start // (least // 2), "start": start, "end": end})
                cover = cover.groupby(["doc_a", "block"], as_index=False).agg({"start": "min", "end": "max"})
                yield cover.assign(doc_b=np.int64(-1))[["doc_a", "doc_b", "start", "end"]]

    def run(batches):
        now, held, shard = None, [], None
        for pdf in batches:
            for key, rows in pdf.groupby(["shard", "salt"], sort=False):
                if key != now:
                    now, held, shard = key, [], None
                own = rows[rows["role"] == 0]
                if len(own):
                    held.append(own)
                streamed = rows[rows["role"] == 1]
                if len(streamed) and held:
                    if shard is None:
                        everything = pd.concat(held)
                        shard = _Shard(everything["doc_id"].tolist(), everything["part"].tolist(), least)
                    for i in range(0, len(streamed), 500):
                        yield from answer(shard, streamed.iloc[i : i + 500])

    return run


def _text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: texts are taken as copies when both agree."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def text_classes(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``rep``, ``n_copies``, ``n_chars`` of every text with at least ``least`` characters.

    ``rep`` is the smallest id with exactly this text. Only hashes are shuffled.
    """
    keyed = documents.where(F.length("text") >= least).select("doc_id", *_text_keys(F.col("text")), F.length("text").alias("n_chars")).dropDuplicates(["doc_id"])
    reps = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    return keyed.join(reps, ["k1", "k2"]).select("doc_id", "rep", "n_copies", "n_chars")


def shared_spans(documents: DataFrame, classes: DataFrame, least: int = LEAST, pairs: bool = True) -> DataFrame:
    """Matches between different texts, by class representative: ``doc_a, doc_b, start, end``.

    With ``pairs`` the rows are pairs of representatives that share a run of ``least`` characters; without, each row says
    that ``doc_a`` shares the characters from ``start`` to ``end`` with some other text (``doc_b`` is -1), and no pair is
    made. Null and short texts take no part. A run is counted in code points.
    """
    if least < GRAM + 64:
        raise ValueError(f"least must be {GRAM + 64} or more")
    keyed = documents.where(F.length("text") >= least).select("doc_id", F.xxhash64("text").alias("k1"), "text")
    sampled = cut(keyed.mapInPandas(_anchor_rows(least), "hash long, doc_id long, k1 long, pos int"))
    sampled = _cooled(sampled, keyed, least)
    # two aggregates of one row per hash are combined before the shuffle, so a hash that all texts have costs little
    shared = sampled.groupBy("hash").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("hash")
    reps = classes.where("doc_id = rep").select("doc_id")
    hits = cut(sampled.join(shared, "hash", "left_semi").join(reps, "doc_id", "left_semi").select("hash", "doc_id", "pos"))
    shards = max(1, -(-hits.count() * (least // 2) // SHARD_CHARS))
    placed = hits.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(shards)).cast("int"))
    holding = placed.select("hash", F.col("own").alias("shard")).distinct()
    routes = placed.select("hash", "doc_id").join(holding, "hash").select("doc_id", "shard").distinct()
    salts = routes.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("salts"))
    routed = (
        routes.join(salts, "shard")
        .select("doc_id", F.struct("shard", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("salts")).cast("int").alias("salt")).alias("route"))
        .groupBy("doc_id").agg(F.collect_list("route").alias("routes"))
    )
    per_doc = placed.groupBy("doc_id", "own").agg(F.collect_list("pos").alias("positions"))
    plan = per_doc.join(salts.select(F.col("shard").alias("own"), F.col("salts").alias("own_salts")), "own").join(routed, "doc_id")
    rows = documents.select("doc_id", "text").join(plan, "doc_id").dropDuplicates(["doc_id"])
    sent = rows.mapInPandas(_send(least), "shard int, salt int, role int, doc_id long, begin long, part string")
    arranged = sent.repartition(max(shards, 2), "shard", "salt").sortWithinPartitions("shard", "salt", "role")
    return arranged.mapInPandas(_search(least, pairs), "doc_a long, doc_b long, start long, end long")


def _cooled(sampled: DataFrame, keyed: DataFrame, least: int) -> DataFrame:
    """The sampled hashes, those that very many rows have replaced by hashes of longer stretches around the grams.

    A gram of a licence or a header stands in a large part of all texts, and would send each of them to the index of
    every other. Texts that share no more than such a piece part here; those that share a run of ``least`` characters
    still have a hash in common.
    """
    hot = cut(sampled.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash"))
    n = hot.count()
    if not n:
        return sampled
    few = n <= HOT_HASHES
    shared = sampled.sparkSession.sparkContext.broadcast(hot.toPandas()["hash"].to_numpy(np.int64) if few else None)
    longer = cut(keyed.mapInPandas(_anchor_rows(least, shared), "hash long, doc_id long, k1 long, pos int"))
    return sampled.join(F.broadcast(hot), "hash", "left_anti").unionByName(longer) if few else longer


def span_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Each pair of different documents that share a run of at least ``least`` characters, smaller id first."""
    classes = cut(text_classes(documents, least))
    between = shared_spans(documents, classes, least).select("doc_a", "doc_b").distinct()
    of_a = classes.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("a"))
    of_b = classes.select(F.col("rep").alias("doc_b"), F.col("doc_id").alias("b"))
    across = between.join(of_a, "doc_a").join(of_b, "doc_b").select("a", "b")
    copies = classes.where("n_copies > 1")
    within = copies.select("rep", F.col("doc_id").alias("a")).join(copies.select("rep", F.col("doc_id").alias("b")), "rep").where("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def shared_share(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """For every document how many of its characters stand in runs of at least ``least`` that another one has too.

    ``doc_id, n_chars, shared_chars, shared_share``. All of a text with exact copies is shared. Null texts have null
    ``n_chars`` and share 0; empty and short ones share 0.
    """
    classes = cut(text_classes(documents, least))
    cover = shared_spans(documents, classes, least, pairs=False)
    cover = cover.groupBy("doc_a", "start").agg(F.max("end").alias("end")).groupBy("doc_a").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct(
            (acc["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))).alias("sum"), F.greatest(acc["to"], x["end"]).alias("to")
        ),
        lambda acc: acc["sum"],
    )
    of_rep = cover.select(F.col("doc_a").alias("rep"), union.alias("in_spans"))
    found = classes.join(of_rep, "rep", "left").select("doc_id", F.when(F.col("n_copies") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("in_spans", F.lit(0))).alias("shared_chars"))
    everything = documents.select("doc_id", F.length("text").cast("long").alias("n_chars")).dropDuplicates(["doc_id"])
    out = everything.join(found, "doc_id", "left").fillna(0, ["shared_chars"])
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
