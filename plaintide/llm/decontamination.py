"""Documents that hold passages of a benchmark, by suffix arrays over the training words.

Every task lays its documents out in shards of words and builds a suffix array of each: the positions where a match
can start, in the order of the words that follow. The words of a benchmark item from each of its words on (a test
suffix) are binary-searched in every shard, which gives where it occurs and how far it runs on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm.arrow import portions, type_of
from plaintide.llm.byte_words import Chunks, Vocabulary, stretches
from plaintide.llm.scratch import written

#: Words that must match in a row; an item with fewer has to match as a whole.
WINDOW = 10
#: Words of a shard; bytes of text laid out at once; bytes of benchmark text searched in one pass over the documents.
SHARD, BYTES, PORTION = 1 << 20, 16 << 20, 16 << 20

# The bytes of a word (digits, letters, every byte of a character beyond ASCII), A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x41:0x5B] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def item_words(text: str | None) -> list[bytes]:
    """The lower-cased words of one text."""
    found = []
    for part in stretches(pa.array([text], pa.string()), _INSIDE):
        data = _LOWER[part.data]
        starts, lengths, _ = part.words(_INSIDE[data])
        content = data.tobytes()
        found += [content[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
    return found


class TestSuffixes:
    """The words of a portion of the benchmark as numbers, and the windows to be searched."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = [(name, words) for name, text in items if (words := item_words(text))]
        distinct = sorted({w for _, words in texts for w in words})
        number = {w: i + 1 for i, w in enumerate(distinct)}
        self.vocabulary = Vocabulary(distinct)
        self.names = [name for name, _ in texts]
        lengths = np.array([len(words) for _, words in texts], np.int64)
        self.words = np.array([number[w] for _, words in texts for w in words], np.int64)
        self.item_start = np.cumsum(lengths) - lengths
        self.item_end = self.item_start + lengths
        self.longest = int(lengths.max()) if len(lengths) else 0
        size = np.minimum(lengths, window)
        self.shortest = int(size.min()) if len(size) else 0
        # Every window: the item, the place of its first word and its number of words.
        per_item = lengths - size + 1
        self.item = np.repeat(np.arange(len(lengths)), per_item)
        behind = np.arange(len(self.item)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        self.place = self.item_start[self.item] + behind if len(lengths) else np.empty(0, np.int64)
        self.size = size[self.item] if len(lengths) else np.empty(0, np.int64)
        known: dict[tuple, int] = {}
        listed = self.words.tolist()
        ends = (self.place + self.size).tolist()
        kinds = [known.setdefault(tuple(listed[a:b]), len(known)) for a, b in zip(self.place.tolist(), ends)]
        #: Windows with the same words are of one kind; `kind_first` is one of them.
        self.kind = np.array(kinds, np.int64)
        self.kind_first = np.unique(self.kind, return_index=True)[1] if kinds else np.empty(0, np.int64)
        order = np.argsort(self.kind, kind="stable")
        self.kind_items = np.split(self.item[order], np.searchsorted(self.kind[order], np.arange(1, len(known))))


class SuffixArray:
    """Order of the suffixes of a shard, by the first `depth` words after each position or more.

    `words` holds numbers from 1 on, 0 where nothing can match; a suffix ends before the next 0. Only stretches
    of at least `shortest` words are kept, as no match fits into a shorter one. The first sort is by as many words
    as fit into 63 bits; positions that are still equal are sorted by the rank of what follows, with doubled length
    each time.
    """

    def __init__(self, words: np.ndarray, depth: int, shortest: int, top: int):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], words > 0, [False])).astype(np.int8)))
        first, end = edges[0::2], edges[1::2]
        long = end - first >= max(shortest, 1)
        first, lengths = first[long], end[long] - first[long]
        # One 0 behind each stretch.
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.place = np.repeat(first - starts, lengths + 1) + np.arange(int((lengths + 1).sum()))
        self.words = words[np.minimum(self.place, len(words) - 1)] if len(self.place) else np.empty(0, np.int64)
        if len(lengths):
            self.words[starts + lengths] = 0
        n = len(self.words)
        self.bits = int(top).bit_length()
        self.packed = max(1, 63 // max(self.bits, 1))
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(self.packed):
            word = np.zeros(n, np.int64)
            word[: max(n - j, 0)] = self.words[j:]
            alive &= word > 0
            key = (key << self.bits) | np.where(alive, word, 0)
        order = np.argsort(key)
        order = order[np.searchsorted(key[order], 1) :]
        self.order, self.keys = order, key[order]
        rank = np.zeros(n + 1, np.int64)
        tied, own, follow, done = np.arange(len(order)), np.zeros(len(order), np.int64), self.keys, self.packed
        while len(tied):
            # Positions in `tied` are sorted by what they share so far; equal neighbours stay together.
            head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1]))))
            sizes = np.diff(np.append(head, len(tied)))
            own = np.repeat(tied[head], sizes)
            rank[order[tied]] = own + 1
            if done >= depth:
                break
            open_ = np.repeat(sizes > 1, sizes)
            tied, own = tied[open_], own[open_]
            at = order[tied]
            follow = rank[np.minimum(at + done, n)]
            by = np.argsort(own * (n + 1) + follow)
            order[tied], follow = at[by], follow[by]
            own = own[by]
            done *= 2

    def ranges(self, words: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in the order of the suffixes that begin with words[place : place + size], for each place."""
        low, high = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        taken = np.minimum(size, self.packed)
        for n in np.unique(taken).tolist():
            own = np.flatnonzero(taken == n)
            key = np.zeros(len(own), np.int64)
            for j in range(n):
                key = (key << self.bits) | words[place[own] + j]
            rest = self.bits * (self.packed - n)
            low[own] = np.searchsorted(self.keys, key << rest)
            high[own] = np.searchsorted(self.keys, (key << rest) + ((1 << rest) - 1), side="right")
        return self.narrowed(words, place, size, taken, low, high)

    def narrowed(self, words, place, size, depth, low, high) -> tuple[np.ndarray, np.ndarray]:
        """The bounds after the words from `depth` up to `size` are compared too; empty ones have low == high."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero((depth < size) & (low < high))
        at = depth.copy()
        while len(open_):
            low[open_], high[open_] = self._step(words[place[open_] + at[open_]], at[open_], low[open_], high[open_])
            at[open_] += 1
            open_ = open_[(at[open_] < size[open_]) & (low[open_] < high[open_])]
        return low, high

    def _step(self, word, depth, low, high):
        """Bounds of the suffixes whose word number `depth` is `word`, inside bounds that share all before."""
        ends = []
        for beyond in (0, 1):
            a, b = low.copy(), high.copy()
            while True:
                going = np.flatnonzero(a < b)
                if not len(going):
                    break
                middle = (a[going] + b[going]) >> 1
                right = self.words[self.order[middle] + depth[going]] < word[going] + beyond
                a[going[right]] = middle[right] + 1
                b[going[~right]] = middle[~right]
            ends.append(a)
        return ends[0], ends[1]

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions inside the bounds, as the shard counts words, and the number of the bound of each."""
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.place[self.order[low[which] + within]], which


class Documents:
    """Words of a run of texts as numbers of the test vocabulary, one 0 behind each text."""

    def __init__(self, column: pa.Array, tests: TestSuffixes):
        numbers, rows = [], []
        for part in stretches(column, _INSIDE):
            data = _LOWER[part.data]
            starts, lengths, owner = part.words(_INSIDE[data])
            numbers.append(tests.vocabulary.numbers(Chunks(data), starts, lengths).astype(np.int32))
            rows.append(np.bincount(owner, minlength=len(column)))
        self.counts = sum(rows) if rows else np.zeros(len(column), np.int64)
        #: Place of the first word of each text.
        self.first = np.cumsum(self.counts + 1) - self.counts - 1
        self.words = np.zeros(int((self.counts + 1).sum()), np.int64)
        if numbers:
            flat = np.concatenate(numbers)
            self.words[np.arange(len(flat)) + np.repeat(np.arange(len(column)), self.counts)] = flat

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def shards(self, tests: TestSuffixes, size: int = SHARD) -> Iterator[tuple[int, int, SuffixArray]]:
        """(a, b, suffix array) for the suffixes that start in [a, b); the words a match can need beyond b are in it."""
        size = max(size, 4 * tests.longest)
        for a in range(0, len(self.words), size):
            b = min(a + size, len(self.words))
            held = self.words[a : b + tests.longest]
            yield a, b, SuffixArray(held, tests.longest, tests.shortest, tests.vocabulary.size)


def occurrences(docs: Documents, tests: TestSuffixes, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Every place where a window occurs and the kind of window, for all shards."""
    places, kinds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    chosen = tests.kind_first
    for a, b, suffixes in docs.shards(tests, shard):
        low, high = suffixes.ranges(tests.words, tests.place[chosen], tests.size[chosen])
        at, which = suffixes.places(low, high)
        own = at + a < b
        places.append(at[own] + a)
        kinds.append(which[own])
    return np.concatenate(places), np.concatenate(kinds)


def _portion_items(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """The items in portions of about `most` bytes of text, each of which the driver can hold.

    Items are dealt out by a hash; the number of portions doubles until none holds more than 2 * most bytes or
    each such one is a single item. A benchmark of up to `most` bytes is one portion.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).distinct()
    items = items.filter("text IS NOT NULL")
    size, parts = F.octet_length("text"), 1
    total = items.agg(F.sum(size)).first()[0] or 0
    while parts * most < total:
        parts *= 2

    def part_of(n):
        return F.pmod(F.xxhash64("name", "text"), F.lit(n))

    while parts > 1:
        held = items.groupBy(part_of(parts).alias("part")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
        if held.filter((F.col("bytes") > 2 * most) & (F.col("n") > 1)).isEmpty():
            break
        parts *= 2
    for part in range(parts):
        rows = items.filter(part_of(parts) == part).collect()
        yield sorted(((r["name"], r["text"]) for r in rows), key=lambda x: (x[0] or "", x[1]))


def _broadcast_tests(spark: SparkSession, items: list[tuple], window: int):
    """Items of one portion, whose size is bounded by _portion_items; tasks number their words once per worker."""
    return spark.sparkContext.broadcast((items, window))


_tests: dict[int, TestSuffixes] = {}


def _tests_of(shared, key: int) -> TestSuffixes:
    if key not in _tests:
        _tests.clear()
        _tests[key] = TestSuffixes(*shared.value)
    return _tests[key]


def _runs(batches, most: int = BYTES):
    """Slices of Arrow batches with about `most` bytes of `_text` each."""
    for batch in batches:
        texts = batch.column("_text")
        sizes = [x or 0 for x in pc.binary_length(texts).to_pylist()]
        for a, b in portions(sizes, most):
            yield batch.slice(a, b - a)


def _scanned(docs: DataFrame, shared, key: int, kind: str) -> DataFrame:
    """_row, _id, n_words, spans, item_ids of every row, against the portion of the benchmark in `shared`."""
    schema = f"_row bigint, _id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"

    def scan(batches):
        tests = _tests_of(shared, key)
        for rows in _runs(batches):
            found = Documents(rows.column("_text"), tests)
            places, kinds = occurrences(found, tests)
            owner = found.row_of(places)
            size = len(found.words) + 1
            ends = places + tests.size[tests.kind_first[kinds]]
            hit = np.cumsum(np.bincount(places, minlength=size) - np.bincount(ends, minlength=size))[:-1] > 0
            bounds = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
            first, end = bounds[0::2], bounds[1::2]
            holder = found.row_of(first)
            offset = found.first[holder]
            pairs = pa.StructArray.from_arrays(
                [pa.array(first - offset, pa.int64()), pa.array(end - offset, pa.int64())], names=["start", "end"])
            per_row = np.bincount(holder, minlength=len(rows))
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)), pa.int32()), pairs)
            names: list[list[str]] = [[] for _ in range(len(rows))]
            met = np.unique(owner * max(len(tests.kind_first), 1) + kinds)
            row, which = np.divmod(met, max(len(tests.kind_first), 1))
            cuts = np.flatnonzero(np.diff(row)) + 1
            for r, own in zip(row[np.append(0, cuts)].tolist() if len(row) else [], np.split(which, cuts)):
                every = np.unique(np.concatenate([tests.kind_items[k] for k in own.tolist()]))
                names[r] = sorted({tests.names[i] for i in every.tolist() if tests.names[i] is not None})
            yield pa.RecordBatch.from_arrays(
                [rows.column("_row"), rows.column("_id"), pa.array(found.counts, pa.int64()), spans,
                 pa.array(names, pa.list_(pa.string()))],
                names=["_row", "_id", "n_words", "spans", "item_ids"],
            )

    return docs.select("_row", "_id", "_text").mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  portion: int = PORTION) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, spans, item_ids, contaminated.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A window is `window`
    words of an item in a row; an item with fewer words is one window, one without words none. `spans` are the
    longest stretches of words (start, end exclusive) that lie inside occurrences of windows, `n_hit` the words in
    them, `item_ids` the ids, as sorted strings, of the items with such windows. Null and empty texts have no
    words. Document ids may be null or repeat: each row is answered by itself. Items that share an id count as
    one; an item without an id marks words but is not listed. Without items or documents nothing is hit.

    The benchmark is searched in portions of bounded size, which are broadcast, each in one pass over the documents
    without a shuffle. With a single portion that is all; with more, the documents are written once with row
    numbers and the answers of the passes are grouped by row.
    """
    spark, kind = docs.sparkSession, type_of(docs, id_col)
    chosen = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                         F.col(text_col).alias("_text"))
    parts, first = [], None
    for number, items in enumerate(_portion_items(benchmark, item_id_col, item_text_col, portion)):
        if number == 0:
            first = items
            continue
        if number == 1:
            chosen = written(chosen, "documents")
            parts.append(_scanned(chosen, _broadcast_tests(spark, first, window), _key(), kind))
        parts.append(_scanned(chosen, _broadcast_tests(spark, items, window), _key(), kind))
    if not parts:
        answers = _scanned(chosen, _broadcast_tests(spark, first, window), _key(), kind)
    else:
        parts = [written(p, "portion") for p in parts]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        answers = every.groupBy("_row").agg(
            F.first("_id").alias("_id"), F.max("n_words").alias("n_words"),
            _united(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return answers.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "item_ids",
                          (F.size("spans") > 0).alias("contaminated"))


_passes = iter(range(1 << 62))


def _key() -> int:
    return next(_passes)


def _united(spans):
    """Sorted spans with those that overlap or touch made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        more = F.concat(done, F.array(span))
        return F.when(F.size(done) == 0, more).when(
            last["end"] >= span["start"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(more)

    return F.aggregate(spans, empty, add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, portion: int = PORTION) -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, with all their columns; no shuffle."""
    kept = docs.withColumn("_clean_text", F.col(text_col))
    for items in _portion_items(benchmark, item_id_col, item_text_col, portion):
        shared, key = _broadcast_tests(docs.sparkSession, items, window), _key()

        def clean(batches, shared=shared, key=key):
            tests = _tests_of(shared, key)
            for batch in batches:
                sizes = [x or 0 for x in pc.binary_length(batch.column("_clean_text")).to_pylist()]
                for a, b in portions(sizes, BYTES):
                    rows = batch.slice(a, b - a)
                    found = Documents(rows.column("_clean_text"), tests)
                    places, _ = occurrences(found, tests)
                    keep = np.ones(len(rows), bool)
                    keep[found.row_of(places)] = False
                    yield rows.filter(pa.array(keep))

        kept = kept.mapInArrow(clean, kept.schema)
    return kept.drop("_clean_text")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                    portion: int = PORTION) -> DataFrame:
    """item_id (string), item_word, n_words, doc_id, doc_word: for every test suffix the longest verbatim match.

    Only matches of at least a window are reported. Of equally long ones the smallest doc_id (null last), then
    the earliest word counts. Each shard sends on its best match of a suffix; the best of all is a grouped minimum.
    """
    kind = type_of(docs, id_col)
    schema = f"item_id string, item_word bigint, n_words bigint, _id {kind}, doc_word bigint"
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = None
    for items in _portion_items(benchmark, item_id_col, item_text_col, portion):
        shared, key = _broadcast_tests(docs.sparkSession, items, window), _key()

        def match(batches, shared=shared, key=key):
            tests = _tests_of(shared, key)
            for rows in _runs(batches):
                held = Documents(rows.column("_text"), tests)
                ids = rows.column("_id")
                for a, b, suffixes in held.shards(tests):
                    for w, at, n in longest_in(suffixes, tests, b - a):
                        row = int(held.row_of(np.array([at + a]))[0])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tests.names[tests.item[w]]], pa.string()),
                             pa.array([int(tests.place[w] - tests.item_start[tests.item[w]])], pa.int64()),
                             pa.array([n], pa.int64()), ids.slice(row, 1),
                             pa.array([int(at + a - held.first[row])], pa.int64())],
                            names=["item_id", "item_word", "n_words", "_id", "doc_word"])

        part = chosen.mapInArrow(match, schema)
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("_id").isNull().alias("z"), "_id", "doc_word"))
    return found.groupBy("item_id", "item_word").agg(best.alias("_best")).select(
        "item_id", "item_word", (-F.col("_best.n")).alias("n_words"), F.col("_best._id").alias(id_col),
        F.col("_best.doc_word").alias("doc_word"))


def longest_in(suffixes: SuffixArray, tests: TestSuffixes, own: int) -> Iterator[tuple[int, int, int]]:
    """(window, place, words) of the longest match of every test suffix that matches by a window or more.

    Places from `own` on belong to the next shard.
    """
    low, high = suffixes.ranges(tests.words, tests.place, tests.size)
    size = tests.size.copy()
    ends = tests.item_end[tests.item]
    met = np.flatnonzero(low < high)
    best: dict[int, tuple[int, int]] = {}
    while len(met):
        at, which = suffixes.places(low[met], high[met])
        inside = at < own
        at, which = at[inside], which[inside]
        heads = np.unique(which, return_index=True)[1]
        firsts = np.minimum.reduceat(at, heads) if len(at) else at
        for i, place in zip(which[heads].tolist(), firsts.tolist()):
            best[int(met[i])] = (place, int(size[met[i]]))
        met = met[np.unique(which)]
        met = met[tests.place[met] + size[met] < ends[met]]
        if not len(met):
            break
        word = tests.words[tests.place[met] + size[met]]
        low[met], high[met] = suffixes._step(word, size[met], low[met], high[met])
        size[met] += 1
        met = met[low[met] < high[met]]
    for window, (place, n) in sorted(best.items()):
        yield window, place, n
