"""Words grouped with their spelling variants: single edits found by dense tiles of padded code points.

Two words are one edit apart if their common prefix and common suffix together reach the longer length minus one.
Every such pair shares the first half of the shorter word or the rest of it, so words are put into tiles by both;
within a tile all rows are compared at once, column by column.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.byte_words import Chunks, stretches
from plaintide.llm.scratch import written
from plaintide.operators.skew import lookup

#: Rows of a block of a large group; rows up to which small groups share a tile; cells of a matrix.
BLOCK, TILE, CELLS = 1024, 256, 1 << 22
#: Distinct words counted in a task before they are sent on.
HELD = 1 << 20
#: Columns up to which a tile is compared column by column.
NARROW = 64

# The bytes of A-Z, a-z and U+00C0 to U+00FF, which are C3 and a byte behind it; the polynomial of crc32.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_POSSIBLE = _LETTER.copy()
_POSSIBLE[0x80:0xC0] = _POSSIBLE[0xC3] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of `data` as the continuation of a crc32 in `before`."""
    found = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > NARROW).tolist():
        word = data[starts[i] : starts[i] + lengths[i]].tobytes()
        found[i] = zlib.crc32(word, int(before[i])) ^ 0xFFFFFFFF
    short = np.where(lengths > NARROW, 0, lengths)
    order = np.argsort(-short.astype(np.int16), kind="stable")
    at, state = starts[order], found[order]
    longer = np.searchsorted(-short[order], -np.arange(NARROW), side="left")
    for j, n in enumerate(longer.tolist()):
        if not n:
            break
        own = state[:n]
        state[:n] = _CRC[(own ^ data[at[:n] + j]) & 255] ^ (own >> np.uint32(8))
    found[order] = state
    return found ^ np.uint32(0xFFFFFFFF)


def _count_keys(keys: list[np.ndarray], held: Counter) -> None:
    """Adds words given by their eight-byte pieces (one or two)."""
    if len(keys) == 1:
        found, n = np.unique(keys[0], return_counts=True)
        columns = [found]
    else:
        parts = [np.unique(k, return_inverse=True) for k in keys]
        width = len(parts[1][0])
        both, n = np.unique(parts[0][1].astype(np.int64) * width + parts[1][1], return_counts=True)
        columns = [parts[0][0][both // width], parts[1][0][both % width]]
    words = np.ascontiguousarray(np.stack(columns, axis=1)).view(f"S{8 * len(columns)}").ravel()
    for word, count in zip(words.tolist(), n.tolist()):
        held[word] += count


def count_words(column: pa.Array, names: list[str], held: Counter, letters: int, slip: int | None) -> None:
    """Adds the words of the texts (as UTF-8) with at least `letters` code points to `held`."""
    prefix = np.array([zlib.crc32(f"{name}:".encode()) for name in names], np.uint32)
    for part in stretches(column, _POSSIBLE):
        data = _LOWER[part.data]
        lead = data == 0xC3
        inside = _LETTER[data] | lead
        inside[1:] |= lead[:-1]
        starts, lengths, rows = part.words(inside)
        wide = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
        points = lengths - (wide[starts + lengths] - wide[starts])
        long = points >= letters
        starts, lengths, rows, points = starts[long], lengths[long], rows[long], points[long]
        if slip and len(starts):
            sums = crc32_of(data, starts, lengths, prefix[rows]).astype(np.int64)
            slipped = sums % slip == 0
            for i in np.flatnonzero(slipped & (points > letters)).tolist():
                word = data[starts[i] : starts[i] + lengths[i]].tobytes().decode()
                cut = int(sums[i] % points[i])
                held[(word[:cut] + word[cut + 1 :]).encode()] += 1
            starts, lengths = starts[~slipped], lengths[~slipped]
        chunks = Chunks(data)
        for pieces in (1, 2):
            own = (lengths > 8 * pieces - 8) & (lengths <= 8 * pieces)
            if own.any():
                _count_keys([chunks.get(starts[own], lengths[own], k) for k in range(pieces)], held)
        for i in np.flatnonzero(lengths > 16).tolist():
            held[data[starts[i] : starts[i] + lengths[i]].tobytes()] += 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6,
                least: int = 5, slip: int | None = None) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of all texts and how often each occurs.

    Words of fewer than `letters` code points or `least` occurrences are left out; null texts have none. With `slip`,
    misspellings are planted for tests: where it divides the crc32 of `<id>:<word>`, the word loses the code point
    numbered crc32 % length (a null id counts as an empty one). Tasks send their sums on, a bounded table at a time.
    """
    chosen = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), F.col(text_col).alias("_text"))

    def sums(held: Counter) -> pa.RecordBatch:
        words = [w.decode() for w in held]
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    def count(batches):
        held: Counter = Counter()
        for rows in batches:
            count_words(rows.column(1), rows.column(0).to_pylist(), held, letters, slip)
            if len(held) > HELD:
                yield sums(held)
        yield sums(held)

    counted = chosen.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words, padded with zeros on the right, and on the left."""
    left = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    if left.max() < 256:
        left = left.astype(np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    columns = np.arange(width) - (width - lengths)[:, None]
    right = np.where(columns >= 0, np.take_along_axis(left, np.maximum(columns, 0), axis=1), 0)
    return left, right


def _run_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns agree, for every row of `a` with every row of `b`."""
    width = a.shape[1]
    if width > NARROW:
        found = np.empty((len(a), len(b)), np.int32)
        for i in range(len(a)):
            same = a[i] == b
            found[i] = np.where(same.all(axis=1), width, same.argmin(axis=1))
        return found
    found = np.zeros((len(a), len(b)), np.uint8)
    alive = np.ones((len(a), len(b)), bool)
    for j in range(width):
        alive &= a[:, j, None] == b[None, :, j]
        found += alive
    return found


def near_in_tile(words: list[str], shorter: int, half: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of single edits with words[i] of `shorter` code points and words[j] of as many or one more.

    Pairs of equal length come in both orders. A tile by prefix gives the pairs that share `half` leading code
    points, one by suffix those that share the other code points at the end but not `half` at the front, so no pair
    is given twice.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.flatnonzero(lengths == shorter)
    if not len(first):
        return first, first
    left, right = _codes(words, shorter + 1)
    prefix = _run_lengths(left[first, :shorter], left[:, :shorter])
    # Behind the right edge: the last `shorter` code points, from the end.
    suffix = _run_lengths(right[first, :0:-1], right[:, :0:-1])
    near = prefix.astype(np.int32) + suffix >= lengths[None, :] - 1
    near &= ~((prefix == shorter) & (lengths == shorter)[None, :])
    near &= (suffix >= shorter - half) & (prefix < half) if by_suffix else prefix >= half
    i, j = np.nonzero(near)
    return first[i], j


def _tiles(batches) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """(shorter, side, rows) of each tile from sorted batches; tiles of small groups go together up to TILE rows."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        heads = np.flatnonzero(np.diff(batch.column("tile").dictionary_encode().indices.to_numpy())) + 1
        cuts = [0, *heads.tolist(), len(batch)]
        names, shorter, side, blocks = (batch.column(n).take(pa.array(cuts[:-1])).to_pylist()
                                        for n in ("tile", "shorter", "side", "blocks"))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            now = (names[k], shorter[k], side[k], blocks[k])
            if held and now != last:
                together = now[1:] == last[1:] and now[3] == 1
                if not together or size + b - a > min(TILE, CELLS // (now[1] + 1)):
                    yield last[1], last[2], held
                    held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, last = size + b - a, now
    if held:
        yield last[1], last[2], held


def near_words(words: DataFrame, word_col: str = "word", count_col: str = "n") -> DataFrame:
    """word, n_near, form, form_n for the words with near ones: how many, and the one of the largest count.

    `words` has a distinct word and its count per row; ties of counts go to the smallest word in code-point order.
    Words are placed by the first half of the shorter length and by the rest of it. A group of more than BLOCK words
    is cut into blocks and compared block pair by block pair, each a tile of its own, so no task holds a whole large
    group; pairs stay in the tile, which sends on a count and the best for each of its words.
    """
    word, length = F.col(word_col), F.char_length(word_col)
    shortest = words.agg(F.min(F.char_length(word_col))).first()[0] or 0
    sized = words.select(word.alias("word"), F.col(count_col).alias("n"), length.alias("_length"),
                         F.explode(F.array(length, length - 1)).alias("shorter")).filter(F.col("shorter") >= max(shortest, 1))
    half = F.floor(F.col("shorter") / 2).cast("int")
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("key")),
        F.struct(F.lit(1).alias("side"), F.expr("right(word, shorter - CAST(floor(shorter / 2) AS INT))").alias("key")),
    )).alias("_at")
    placed = sized.select("word", "n", "shorter", sides).select("word", "n", "shorter", "_at.side", "_at.key")
    keys = ["shorter", "side", "key"]
    groups = placed.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(
        *keys, F.ceil(F.col("_n") / F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / (F.col("shorter") + 1)))))
        .cast("int").alias("blocks"))
    rows = lookup(placed, groups, keys, 4 * words.count())
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    tile = F.concat_ws("/", F.col("shorter"), F.col("side"), low, high, F.col("key"))
    tiles = dealt.select("word", "n", "shorter", "side", "blocks", F.col("_own").alias("own"),
                         (low < high).alias("mixed"), tile.alias("tile"))
    spread = tiles.repartition("tile").sortWithinPartitions("shorter", "side", "blocks", "tile")

    def compare(batches):
        for shorter, side, held in _tiles(batches):
            rows = pa.Table.from_batches(held)
            names, counts = rows.column("word").to_pylist(), rows.column("n").to_numpy()
            i, j = near_in_tile(names, shorter, shorter // 2, side == 1)
            if rows.column("mixed")[0].as_py():
                # Pairs inside a block are found in the tile of that block with itself.
                block = rows.column("own").to_numpy()
                across = block[i] != block[j]
                i, j = i[across], j[across]
            longer = np.fromiter((len(names[x]) > shorter for x in j.tolist()), bool, len(j))
            a, b = np.concatenate((i, j[longer])), np.concatenate((j, i[longer]))
            if not len(a):
                continue
            best: dict[int, tuple[int, str]] = {}
            for x, y in zip(a.tolist(), b.tolist()):
                offer = (-int(counts[y]), names[y])
                if x not in best or offer < best[x]:
                    best[x] = offer
            many = np.bincount(a, minlength=len(names))
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([names[x] for x in best], pa.string()),
                "near": pa.array(many[list(best)], pa.int64()),
                "best_n": pa.array([-v[0] for v in best.values()], pa.int64()),
                "best": pa.array([v[1] for v in best.values()], pa.string()),
            })

    found = spread.mapInArrow(compare, "word string, near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("_best")).select(
        "word", "n_near", F.col("_best.w").alias("form"), (-F.col("_best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the words that have a form: the end of the chain of forms.

    Each round looks up where the present end leads to, so the steps double; a form's count is a multiple of its
    word's, so there are about log2(log(largest count)) rounds, each written.
    """
    ends = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(ends.join(ahead, "root", "left").select("word", "root", "_next"), "forms")
        ends = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.filter("_next IS NOT NULL").isEmpty():
            return ends


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6,
                      least: int = 5, times: int = 5, slip: int | None = None) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words and counts are those of `word_counts`. Two words are near if one code point inserted, deleted or replaced
    makes one of the other. The form is the near word of the largest count (ties: the smallest in code-point
    order) if that is at least `times` the word's own, else null; root follows forms to the last and is the word
    itself if there is none. n_near counts near words; form_n is the form's count. Null and empty texts, and empty
    tables, give no words; a repeated row counts again; other columns are not read.
    """
    words = written(word_counts(docs, id_col, text_col, letters, least, slip), "words")
    near = near_words(words)
    good = F.col("form_n") >= F.col("n") * times
    known = written(
        words.join(near, "word", "left").select(
            "word", F.when(good, F.col("form")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")),
        "near-words",
    )
    return known.join(roots(known), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
