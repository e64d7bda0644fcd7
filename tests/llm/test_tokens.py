"""Token counts, byte-level encoding and token files against the libraries, and exact round trips."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from plaintide.llm import byte_bpe, scratch, simple8b, token_counts, token_file
from plaintide.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_file
from plaintide.llm.segments import CHUNK, Layout, WordTable, byte_level_words, layouts
from tests.llm.conftest import answers

BYTES, PIECES = tokenizer_file(BYTE_BPE), tokenizer_file(PIECE_BPE)
LIBRARY = Tokenizer.from_file(BYTES)
SENTENCES = SentencePieceProcessor(model_file=PIECES)
ODD = [
    "", " ", "  \n\t ", "a  b\n\nc", "don't we'll 'tis ''s 's's x'REd can'ts a 's  'll\t'm", "é12 ½x٣ 　 a\n 'd",
    "▁▁ a▁b", "日本語 テスト 😀\0 \n", "<s> </s> <0x0A> <unk>", "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>z",
    "a" * 3000, "ab " * 2000, "\x1c\x1d \x85  x", "    lots     of      space  ", "x'", "a''re 12'ts",
]


def library_ids(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_ids_and_counts_of_odd_texts():
    assert [x.tolist() for x in byte_bpe.encode(ODD, BYTES)] == library_ids(ODD)
    assert token_counts.count_texts(ODD, PIECES).tolist() == [len(x) for x in SENTENCES.encode(ODD)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.text(st.characters(exclude_categories=["Cs"]), max_size=40),
    st.text("ab'st rvelmd\n\t  ▁1é½,<|>", max_size=60)), min_size=1, max_size=4))
def test_ids_counts_and_round_trip_of_any_text(texts):
    found = byte_bpe.encode(texts, BYTES)
    assert [x.tolist() for x in found] == library_ids(texts)
    assert [byte_bpe.decode(x, BYTES) for x in found] == texts
    assert token_counts.count_texts(texts, PIECES).tolist() == [len(x) for x in SENTENCES.encode(texts)]


def test_very_long_texts_are_cut_between_words_only():
    r = random.Random(3)
    text = "".join(r.choice(["word", "Zeit", "été", "12", "  ", "\n", ",", "'ll"]) + r.choice([" ", " ", ""]) for _ in range(400_000))
    assert len(text) > CHUNK and len(list(layouts([text]))) > 1
    assert byte_bpe.encode([text], BYTES)[0].tolist() == library_ids([text])[0]
    assert token_counts.count_texts([text], PIECES)[0] == len(SENTENCES.encode(text))


def test_broken_sequences_decode_as_the_library_does():
    r = random.Random(4)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randrange(12))]
        assert byte_bpe.decode(ids, BYTES) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_word_table_starts_again_when_full():
    table = token_counts.WordTable(lambda words: [(len(w),) for w in words], most=3)
    for texts in (["aa b"], ["ccc dd e"], ["aa b"], ["a b c d e f"]):
        run = Layout(texts, [0])
        starts, ends = byte_level_words(run)
        assert table.rows(table.find(run, starts, ends))[0].tolist() == (ends - starts).tolist()
        assert table.count <= 6


def thue_morse(n, one="a", other="b"):
    return "".join(other if bin(i).count("1") % 2 else one for i in range(n))


#: Pairs of words with equal sums, whatever odd base the sums have.
TWINS = [thue_morse(n, *own) for n in (1024, 2048, 4096) for own in ("ab", "ba")]


def test_words_whose_sums_collide_are_told_apart():
    assert [x.tolist() for x in byte_bpe.encode(TWINS, BYTES)] == library_ids(TWINS)
    assert token_counts.count_texts(TWINS, PIECES).tolist() == [len(x) for x in SENTENCES.encode(TWINS)]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(Layout, "running", lambda self, codes=None: lambda a, b: np.uint64(7) * (b - a > 2))
    table = WordTable(lambda words: [[len(w), *map(ord, w)] for w in words], room=60)
    r = random.Random(6)
    for _ in range(20):
        texts = [" ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(9)) for _ in range(3)]
        run = Layout(texts, range(3))
        starts, ends = byte_level_words(run)
        numbers, sizes = table.rows(table.find(run, starts, ends))
        want = [[len(w), *map(ord, w)] for w in run.words(starts, ends)]
        assert [x.tolist() for x in np.split(numbers, np.cumsum(sizes)[:-1])] == want


def test_twins_in_a_token_file(spark, docs):
    path = scratch.new_path(spark, "twins")
    token_file.write_token_file(docs(*TWINS).coalesce(1), path, BYTES)
    found = sorted(token_file.read_token_file(spark, path).collect(), key=lambda r: r.start)
    assert [r.ids[:-1] for r in found] == library_ids(TWINS)


def test_token_count_rows(docs):
    got = answers(token_counts.token_counts(docs("a b", None, "", "word " * 5000, ids=[1, 2, None, 4]), PIECES),
                  "n_bytes", "n_tokens", "over_limit")
    assert got[1] == (3, len(SENTENCES.encode("a b")), False) and got[2] == got[None] == (0, 0, False)
    assert got[4] == (25000, len(SENTENCES.encode("word " * 5000)), True)


def test_round_trip_rows(docs):
    texts = ["a b", None, "", "été <|endoftext|>"]
    got = answers(byte_bpe.bpe_round_trip(docs(*texts), BYTES), "n_tokens", "ids_sha256", "decoded_sha256", "exact")
    for i, text in enumerate(texts, 1):
        ids = library_ids([text or ""])[0]
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text or "")]
        assert got[i] == (len(ids), *digest, True)
    encoded = byte_bpe.bpe_encode(docs(*texts), BYTES)
    assert answers(byte_bpe.bpe_decode(encoded, BYTES), "text") == {i: t or "" for i, t in enumerate(texts, 1)}


@pytest.mark.parametrize("top", [0, 1, 5, 16, 31, 60, 61, 64])
def test_simple8b_gives_the_numbers_back(top):
    r = random.Random(top)
    for n in (0, 1, 2, 59, 60, 119, 120, 121, 239, 1000):
        numbers = np.array([r.getrandbits(r.randint(0, top)) for _ in range(n)], np.uint64)
        words, escapes = simple8b.pack(numbers)
        assert (simple8b.unpack(words, escapes, n) == numbers).all()
        if top <= 1:
            assert len(words) <= n / 60 + 1


def test_token_file(spark, docs, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 10)  # in this process only; tasks use the standard size
    texts = ["b c", None, "", "x " * 300_000, "a", "a", "z"]
    ids = [5, 3, None, 1, 9, 9, -2]
    path = scratch.new_path(spark, f"file-{uuid.uuid4().hex}")
    token_file.write_token_file(docs(*texts, ids=ids), path, BYTES)
    found = sorted(token_file.read_token_file(spark, path).collect(), key=lambda r: r.start)
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0], x[1] or ""))
    at = 0
    for row, (i, text) in zip(found, order, strict=True):
        want = [*library_ids([text or ""])[0], 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (i, at, len(want), want)
        at += len(want)
    crc = {r.start: r.ids_crc32 for r in token_file.token_file_digests(spark, path).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found}


def test_empty_tables(spark, docs):
    empty = docs()
    assert token_counts.token_counts(empty, PIECES).count() == 0
    assert byte_bpe.bpe_round_trip(empty, BYTES).count() == 0
    path = scratch.new_path(spark, "empty-file")
    token_file.write_token_file(empty, path, BYTES)
    assert token_file.read_token_file(spark, path).count() == 0


def test_rows_of_one_id_fill_several_shards(spark, docs):
    """A third of the rows has no id and a third one id; shards split them and starts still follow the order."""
    r = random.Random(6)
    texts = ["".join(r.choices("ab c", k=r.randrange(30))) for _ in range(600)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(600)]
    path = scratch.new_path(spark, f"hot-{uuid.uuid4().hex}")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_file.write_token_file(docs(*texts, ids=ids).repartition(4), path, BYTES)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = sorted(token_file.read_token_file(spark, path).collect(), key=lambda x: x.start)
    order = sorted(range(600), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i].encode()))
    assert [(x.doc_id, byte_bpe.decode(x.ids[:-1], BYTES)) for x in found] == [(ids[i], texts[i]) for i in order]
    assert [x.start for x in found] == [sum(x.n_tokens for x in found[:i]) for i in range(600)]
    shards = spark.read.parquet(f"{path}/blocks").selectExpr("shard", "explode(doc_ids) AS id").distinct().collect()
    assert sum(s.id is None for s in shards) > 1 and sum(s.id == 7 for s in shards) > 1
