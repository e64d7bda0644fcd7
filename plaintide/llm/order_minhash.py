"""Near-duplicate texts by order MinHash, verified by banded alignment.

Pairs are verified at an edit similarity of 0.8 over words, but met through sketches of five-word k-mers, so the
chance to meet falls before that: by the review's estimate for scattered word edits, an edit similarity of 0.90 is a
five-word Jaccard of 0.42 and met with 0.84, 0.85 is 0.29 and 0.43, 0.80 is 0.20 and 0.17. Pairs that share a shingle
similarity of 0.8 but differ by a moved block, or by more repeats of one passage, of over 20 % of the words fail the
alignment and both stay.
"""

from __future__ import annotations

import contextlib
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.alignment import Words, similar
from plaintide.llm.arrow import text_batches, type_of
from plaintide.llm.keeping import keep_documents, text_hash
from plaintide.llm.links import components, extended
from plaintide.llm.scratch import written
from plaintide.llm.segments import layouts, mixed, plain_words

#: Words in a k-mer, k-mers in a sketch, sketches of a text.
KMER, SAMPLES, SKETCHES = 5, 3, 24
#: Word counts in a text's profile, whose differences bound the distance from below.
PROFILE = 64
#: Rows on either side of a task that compares what is left of a bucket.
PART = 256
#: Times that what is left of the buckets is compared with single members before all of it is.
TURNS = 2
#: Members of a pivot that are verified in one stretch; rows of an Arrow batch that carries word sequences.
STRETCH, ROWS = 512, 512


def word_hashes(texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
    """The words between white space of each text, lower-cased, as 64-bit hashes, and a digest of the words themselves."""
    hashes, counts, digests = [], np.zeros(len(texts), np.int64), [hashlib.md5() for _ in texts]
    for run in layouts([t.lower() for t in texts]):
        starts, ends = plain_words(run)
        hashes.append(run.running()(starts, ends))
        owners = run.owner_of(starts)
        np.add.at(counts, owners, 1)
        # The code points of the words with a space behind each.
        lengths = ends - starts + 1
        at = np.cumsum(lengths) - lengths
        letters = run.codes[np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))]
        letters[at + lengths - 1] = 32
        heads = np.flatnonzero(np.diff(owners, prepend=-1))
        for head, after in zip(heads.tolist(), np.append(heads[1:], len(owners)).tolist()):
            digests[owners[head]].update(letters[at[head] : at[after - 1] + lengths[after - 1]].tobytes())
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return np.split(every, np.cumsum(counts)[:-1]) if len(texts) else [], [d.digest() for d in digests]


def sketches(words: np.ndarray, seed: int = 1) -> list[int]:
    """One 64-bit key per sketch: SAMPLES k-mers with the smallest hashes, in the order of the text.

    A k-mer is labelled with how often it stood in the text before, so repeats count. A text with fewer k-mers
    gives all of them; one with fewer words than a k-mer has one k-mer of all its words; one without words none.
    """
    if not len(words):
        return []
    size = min(KMER, len(words))
    kmers = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        kmers = mixed(kmers ^ words[i : i + len(kmers)]) + np.uint64(i + 1)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    seen = np.empty(len(kmers), np.uint64)
    seen[order] = np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))
    labelled = mixed(kmers + seen * np.uint64(0x9E3779B97F4A7C15))
    take = min(SAMPLES, len(labelled))
    salts, factors = np.random.default_rng(seed).integers(1, 1 << 63, (2, SKETCHES), dtype=np.uint64)
    keys = []
    at_once = max(1, (1 << 20) // len(labelled))
    for s in range(0, SKETCHES, at_once):
        salt, factor = salts[s : s + at_once, None], factors[s : s + at_once, None] * np.uint64(2) + np.uint64(1)
        drawn = (labelled ^ salt) * factor
        every = np.arange(len(salt))
        chosen = np.empty((len(salt), take), np.int64)
        for j in range(take):
            chosen[:, j] = drawn.argmin(axis=1)
            drawn[every, chosen[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        chosen.sort(axis=1)
        key = salt[:, 0]
        for j in range(take):
            key = mixed(key ^ labelled[chosen[:, j]]) + np.uint64(1)
        keys += key.astype(np.int64).tolist()
    return keys


def profile(words: np.ndarray) -> bytes:
    """How many words fall into each of PROFILE classes, at most 65,535 each."""
    counts = np.bincount((words % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE)
    return np.minimum(counts, 65535).astype("<u2").tobytes()


def _possible(n_a, n_b, profiles_a: np.ndarray, profiles_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the word counts allow the similarity: words that one text has more of need an edit each."""
    longer = np.maximum(n_a, n_b)
    more = profiles_a.astype(np.int32) - profiles_b
    bound = np.maximum(np.maximum(more, 0).sum(-1), np.maximum(-more, 0).sum(-1))
    bound = np.maximum(bound, np.abs(n_a - n_b))
    return bound <= (1 - least) * longer + 1e-9


@contextlib.contextmanager
def _small_batches(df: DataFrame):
    """Arrow batches of few rows while a table with word sequences is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, ROWS)
    try:
        yield
    finally:
        df.sparkSession.conf.set(name, before)


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text_hash, same (digest of the words), n_words, profile, keys, words (bytes) of every row."""
    schema = (f"_id {type_of(docs, id_col)}, _text_hash bigint, same binary, n_words bigint, profile binary, "
              "keys array<bigint>, words binary")

    def sketch(batches):
        for rows, texts in text_batches(batches, "_text"):
            words, digests = word_hashes(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), rows.column(1),
                    pa.array(digests, pa.binary()),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([profile(w) for w in words], pa.binary()),
                    pa.array([sketches(w) for w in words], pa.list_(pa.int64())),
                    # 32 bits tell the words of two texts apart in an alignment.
                    pa.array([w.astype("<u4").tobytes() for w in words], pa.binary()),
                ],
                names=["_id", "_text_hash", "same", "n_words", "profile", "keys", "words"],
            )

    chosen = docs.select(
        F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_text_hash"), F.col(text_col).alias("_text"))
    return chosen.mapInArrow(sketch, schema).withColumn("row", F.monotonically_increasing_id())


def _profiled(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose lengths and profiles allow the similarity."""

    def pass_on(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, PROFILE)
                    for c in ("profile_a", "profile_b"))
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_possible(n_a, n_b, a, b, least)))

    facts = classes.select("cid", "n_words", "profile")
    left = facts.toDF("a", "n_a", "profile_a")
    right = facts.toDF("b", "n_b", "profile_b")
    return pairs.join(left, "a").join(right, "b").mapInArrow(pass_on, "a bigint, b bigint")


def _verified(pairs: DataFrame, classes: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose alignment reaches the similarity.

    Only texts that occur in a pair that profiles allow are moved. The members of a pivot b are dealt out in
    stretches of STRETCH, each with its own copy of the pivot, and stream past it; no task holds a group.
    """
    pairs = written(_profiled(pairs, classes, least), "pairs")
    nodes = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = nodes.join(classes.select("cid", "row"), "cid")
    texts = written(wanted.join(sketched.select("row", "words"), "row").select("cid", "words"), "pair-texts")
    stretches = pairs.groupBy("b").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("_n"))
    stretches = written(stretches, "stretches")
    members = pairs.join(stretches, "b").join(texts.withColumnRenamed("cid", "a"), "a").select(
        "b", F.pmod(F.xxhash64("a"), F.col("_n")).cast("int").alias("part"), "a", "words")
    heads = stretches.join(texts.withColumnRenamed("cid", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"), F.lit(None).cast("bigint").alias("a"), "words")
    lined_up = (
        members.unionByName(heads).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    )

    def align(batches):
        head = None
        for batch in batches:
            found = []
            for b, a, words in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "words"))):
                words = Words(np.frombuffer(words, "<u4"))
                if a is None:
                    head = words
                elif similar(words, head, least):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    with _small_batches(pairs):
        return written(lined_up.mapInArrow(align, "a bigint, b bigint"), "verified")


def _cross_links(buckets: DataFrame, least: float) -> DataFrame:
    """Links a, b between different components of a bucket, enough to connect what similar texts connect.

    A bucket (column key) is dealt into parts of about PART rows and every two parts meet in one task. It looks at
    two texts only in the bucket of the first key they share, only if lengths and profiles allow the similarity,
    and only while no link has joined their components; then it aligns them. Only links leave the task.
    """

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        own, p, q, key = pair["_part"].to_numpy(), pair["_p"].iloc[0], pair["_q"].iloc[0], pair["key"].iloc[0]
        cid, component, n = (pair[c].to_numpy() for c in ("cid", "component", "n_words"))
        profiles = np.frombuffer(b"".join(pair["profile"]), "<u2").reshape(-1, PROFILE)
        keys = np.array(pair["keys"].tolist(), np.int64)
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        found, words, component = [], {}, component.copy()

        def words_of(i):
            if i not in words:
                words[i] = Words(np.frombuffer(pair["words"].iloc[i], "<u4"))
            return words[i]

        for i in left if len(right) else ():
            others = right[(component[right] != component[i]) & ((cid[right] > cid[i]) | (p != q))]
            others = others[_possible(n[i], n[others], profiles[i], profiles[others], least)]
            same = keys[others] == keys[i]
            others = others[keys[i][same.argmax(axis=1)] == key] if len(others) else others
            for j in others:
                if component[i] != component[j] and similar(words_of(i), words_of(j), least):
                    found.append((cid[i], cid[j]))
                    component[component == component[j]] = component[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    parts = F.ceil(F.col("_rows") / PART).cast("int")
    dealt = (
        buckets.withColumn("_part", F.pmod(F.xxhash64("cid"), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("_p", F.least("_part", "_other")).withColumn("_q", F.greatest("_part", "_other"))
    )
    columns = ["key", "_p", "_q", "_part", "cid", "component", "n_words", "profile", "keys", "words"]
    return dealt.select(*columns).groupBy("key", "_p", "_q").applyInPandas(compare, "a bigint, b bigint")


def _open_buckets(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """key, cid and component of the buckets that hold more than one component."""
    placed = members.select("key", "cid").join(grouped.withColumnRenamed("node", "cid"), "cid", "left").select(
        "key", "cid", F.coalesce("component", "cid").alias("component"))
    placed = written(placed, "placed")
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y"))
    mixed_keys = written(mixed_keys.filter("_x <> _y").select("key"), "open-keys")
    return written(placed.join(mixed_keys, "key"), "open-buckets")


def _pivot_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """Every member of a bucket with one member (b) of its largest component, if it isn't in that one.

    The member is drawn by a hash of the turn, alike in all buckets, so a text meets few different ones.
    """
    drawn = F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid")
    parts = buckets.groupBy("key", "component").agg(F.count("*").alias("n"), F.max(drawn).alias("best"))
    heads = parts.groupBy("key").agg(F.max(F.struct("n", "best", "component")).alias("_head"))
    heads = written(heads.select("key", F.col("_head.best.cid").alias("b"), F.col("_head.component").alias("_home")), "pivots")
    return buckets.join(heads, "key").filter("component <> _home").select(F.col("cid").alias("a"), "b").distinct()


def _bucket_links(members: DataFrame, classes: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """node and component of the classes that verified links connect, from the buckets' members (key, cid)."""
    buckets = members.select("key", "cid", F.col("cid").alias("component"))
    grouped = compared = None
    for turn in range(TURNS):
        pairs = _pivot_pairs(buckets, turn)
        pairs = written(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pivot-pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        found = _verified(pairs, classes, sketched, least)
        grouped = components(found) if grouped is None else extended(grouped, found)
        buckets = _open_buckets(buckets, grouped)
        if buckets.isEmpty() or found.isEmpty():
            break
    if buckets.isEmpty():
        return grouped
    sizes = written(buckets.groupBy("key").agg(F.count("*").alias("_rows")), "bucket-sizes")
    facts = classes.select("cid", "row", "n_words", "profile", "keys")
    facts = buckets.select("cid").distinct().join(facts, "cid").join(sketched.select("row", "words"), "row").drop("row")
    rest = buckets.join(sizes, "key").join(written(facts, "open-texts"), "cid")
    with _small_batches(rest):
        crossed = written(_cross_links(rest, least), "crossed")
    return grouped if crossed.isEmpty() else extended(grouped, crossed)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per row of `docs`: id, component_id (smallest id of the group), group_size (rows), kept.

    Texts are sequences of lower-cased words between white space. Two texts are linked if they share a sketch
    (see `sketches`: 24 of them, of 3 five-word k-mers in text order) and an alignment shows a similarity of
    1 - edits / words of the longer text >= `least`. Groups are what links connect. Texts with the same words are
    one class from the start; null texts and texts without words are one class. kept: id = component_id (null
    ids come last; repeated rows with that id are all kept).

    Buckets (texts with the same sketch key) are handled without pairs of members: every member is compared with
    one member only, and in a few more turns those outside the largest component with one of that. This settles
    groups of copies however large, in linear work. Buckets which then still hold several components are compared
    in full, part against part in one task, by word counts that bound the distance from below, and what these
    allow is aligned there; so no two texts that share a sketch escape.
    """
    return _decisions(docs, id_col, text_col, least).drop("_text_hash")


def _decisions(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    with _small_batches(docs):
        sketched = written(_sketched(docs, id_col, text_col), "sketches")
    first = F.min(F.struct("row", "n_words", "profile", "keys")).alias("_first")
    classes = written(
        sketched.groupBy("same").agg(F.min("_id").alias("rep"), F.count("*").alias("n"), first)
        .select("same", "rep", "n", "_first.*").withColumn("cid", F.monotonically_increasing_id()),
        "text-classes",
    )
    entries = written(classes.select(F.explode("keys").alias("key"), "cid").distinct(), "sketch-entries")
    shared = entries.groupBy("key").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("key")
    members = written(entries.join(written(shared, "shared-keys"), "key"), "bucket-members")
    grouped = _bucket_links(members, classes, sketched, least)

    placed = written(
        classes.select("same", "cid", "rep", "n").join(grouped.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid")),
        "classes-placed",
    )
    heads = written(
        placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n").alias("group_size")), "heads")
    answers = written(placed.join(heads, "component").select("same", "component_id", "group_size"), "answers")
    return sketched.select("_id", "_text_hash", "same").join(answers, "same").select(
        F.col("_id").alias(id_col), "component_id", "group_size",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), "_text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of near_duplicates: the one with the smallest id."""
    return keep_documents(docs, _decisions(docs, id_col, text_col, least).filter("kept"), id_col, text_col)
