"""Operators with an exact contract against plain Python, on messy rows and on the small tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm.blocks import Blocks
from barspark.llm.decontamination import contamination
from barspark.llm.gsaca import suffix_array
from barspark.llm.quality_rules import text_features
from barspark.llm.simhash import GENERATOR, anchors, golay, simhash_groups
from barspark.llm.substrings import COVER, PERIOD, remove_substrings
from barspark.llm.suffix_dedup import remove_repeats
from barspark.llm.token_files import Encoder, pack, read_block, read_tokens, token_digests, tokenizer_path, unpack, write_block, write_tokens
from barspark.plans.staging import work_dir

from . import brute
from .conftest import rows_of


def same(got, want):
    assert got == sorted((tuple(w) for w in want), key=repr)


def test_quality_counts(messy, messy_rows, no_documents):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(rows_of(text_features(messy), *names), [(d, *brute.quality(t)) for d, t in messy_rows])
    assert text_features(no_documents).count() == 0


ITEMS = [(1, "The river, of STONE light; paper window garden summer winter train house small large quick"), (2, "slow under"), (3, None), (4, ""), (5, "...")]


@pytest.mark.parametrize("items", [ITEMS, [], "passage"])
def test_contamination(spark, messy, messy_rows, items):
    if items == "passage":
        passage = next(t for d, t in messy_rows if d == 20)
        items = [*ITEMS, (11, passage), (9, passage), (7, "never " + passage[:100])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, block int")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(rows_of(contamination(messy, bench), *names), brute.contamination(messy_rows, items))


def test_contamination_of_nothing(spark, no_documents):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert contamination(no_documents, bench).count() == 0


def test_repeated_bytes(messy, messy_rows, no_documents):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    same(rows_of(remove_repeats(messy), *names), brute.removed_bytes(messy_rows))
    assert remove_repeats(no_documents).count() == 0


def test_kept_bytes_and_words(messy):
    for r in remove_repeats(messy, texts=True).collect():
        assert brute.sha(bytes(r["kept"])) == r["kept_sha256"]
    for r in remove_substrings(messy, texts=True).collect():
        assert brute.sha(r["kept"].encode()) == r["kept_sha256"]


def test_repeated_words(messy, messy_rows, no_documents):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    same(rows_of(remove_substrings(messy), *names), brute.removed_words(messy_rows))
    assert remove_substrings(no_documents).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_blocks_follow_the_text(messy, no_documents):
    assert Blocks(no_documents).count == Blocks(messy).count == 24
    assert Blocks(messy, block_bytes=1000).count > 100


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(x):
    assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_simhash(messy, messy_rows, no_documents):
    same(rows_of(simhash_groups(messy), "doc_id", "fingerprint", "component_id"), brute.simhash_groups(messy_rows))
    assert simhash_groups(no_documents).count() == 0


def test_anchors_meet():
    """The code is perfect, and any two fingerprints within two bits meet at the home of either."""
    home, coset, _ = golay()
    assert GENERATOR.bit_length() == 12 and len(set(coset.tolist())) == 2048 and np.bincount(home).tolist() == [2048] * 4096
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    for bits in (0, 1, 2):
        y = x.copy()
        for _ in range(bits):
            y ^= np.uint64(1) << r.integers(0, 64, len(x), dtype=np.uint64)
        homes, _, _ = anchors(x.view(np.int64))
        other, who, where = anchors(y.view(np.int64))
        copies = set(zip(who.tolist(), where.tolist(), strict=True)) | set(enumerate(other.tolist()))
        assert all((i, h) in copies for i, h in enumerate(homes.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=600))
def test_words_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, escaped = pack(x)
    assert (unpack(words, escaped) == x).all()
    docs, counts, back = read_block(write_block([5, None], [len(ids), 0], x))
    assert docs == [5, None] and counts.tolist() == [len(ids), 0] and (back == x).all()


def test_every_selector_round_trips():
    for width in range(61):
        for n in (1, 7, 240, 700):
            x = np.full(n, (1 << width) - 1, np.uint64)
            assert (unpack(*pack(x)) == x).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "é", ".", " the", "<|endoftext|>", "\t", "1", "'s", "\x1c", "\u3000", "日", "😀", "²", ","]), max_size=12), max_size=5))
def test_encoder_is_the_tokenizer(parts):
    texts = ["".join(p) for p in parts]
    for t, got in zip(texts, ENCODER.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ENCODER.tokenizer.encode(t, add_special_tokens=False).ids


ENCODER = Encoder(tokenizer_path(), cache=50)


def test_token_files(spark, messy, messy_rows, no_documents):
    import zlib

    from tokenizers import Tokenizer

    path = work_dir(spark, "tokens")
    write_tokens(messy, path, tokenizer_path(), block_ids=500)
    t = Tokenizer.from_file(tokenizer_path())
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in messy_rows), key=lambda d: -1 if d is None else d)
    want = sorted((repr(d), [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x in messy_rows)
    assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in got) == want
    at = 0
    for r, q in zip(got, token_digests(spark, path).orderBy("start").collect(), strict=True):
        assert r["start"] == q["start"] == at and q["n_tokens"] == len(r["ids"]) and q["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    empty = work_dir(spark, "tokens")
    write_tokens(no_documents, empty, tokenizer_path())
    assert read_tokens(spark, empty).count() == 0


def test_encoder_of_any_tokenizer():
    """A tokenizer with a normaliser takes whole texts; signs, digits, line ends and added tokens beside letters are cut as the library cuts them."""
    texts = ["Ab<|endoftext|>cd e<|endoftext|> f", "don't 'tis a'b x.\nYou x..\n\nYou a1b2,c é.ß\nÿ", "word,%%% ***a\n\n b\n c.", "", " ", "\n", "a\tb. ćd e"]
    for other in (ENCODER, Encoder(tokenizer_path("word_bpe_49k.json"))):
        assert other.whole == (other is not ENCODER)
        for t, got in zip(texts, other.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == other.tokenizer.encode(t, add_special_tokens=False).ids, t
