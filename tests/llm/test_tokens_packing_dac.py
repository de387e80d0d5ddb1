from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import common, dac, packing, queries, tokens
from quernstone.llm.tokens import ChunkEncoder, default_vocabulary

from .helpers import ODD, clashing, docs

ENCODER = ChunkEncoder(default_vocabulary())


def whole(text):
    return np.array(ENCODER._tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'slt1٣,.!#\n\t  \x1c\x85 　ñ漢\U0001f600̀½_Ⅷ", max_size=40))
def test_chunks_equal_whole_texts(text):
    assert ENCODER.encode(text) == whole(text)


def test_chunks_equal_whole_texts_at_the_memo_limit(monkeypatch):
    monkeypatch.setattr("quernstone.llm.tokens.MEMO_ENTRIES", 3)
    for text in ("a b c d e f g h", "a" * 100 + " " + "b" * 60 + " c  d <|endoftext|> x"):
        assert ENCODER.encode(text) == whole(text)


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_segment_round_trip_and_random_access(ids):
    names = [None if k == 1 else k * 7 - 3 for k in range(len(ids))]
    s = dac.Segment(dac.encode_segment(names, [np.array(x, np.uint32) for x in ids]))
    flat = [y for x in ids for y in x]
    assert s.ids().tolist() == flat and [s.at(k) for k in range(len(flat))] == flat
    assert [None if x == dac.NULL_ID else x for x in s.doc_ids] == names


def test_random_access_over_rank_blocks():
    ids = np.random.default_rng(0).integers(0, 70_000, 5000).astype(np.uint32)
    s = dac.Segment(dac.encode_segment([1], [ids]))
    assert all(s.at(k) == ids[k] for k in range(5000))
    with pytest.raises(IndexError):
        s.at(5000)
    with pytest.raises(ValueError):
        dac.Segment(b"other")


def test_files_hold_documents_in_order(spark):
    rows = dac.digest(dac.read_documents(dac.write_segments(clashing(docs(spark, ODD)), segment_ids=100))).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    want = sorted(zlib.crc32(whole(t) + np.array([2], "<u4").tobytes()) for _, t, *_ in ODD)
    assert sorted(r.ids_crc32 for r in rows) == want
    assert dac.read_documents(dac.write_segments(docs(spark, []))).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_pieces_cover_documents_and_fit(spark):
    rows = packing.digest(packing.pack(clashing(docs(spark, ODD)), capacity=64)).collect()
    n = check_packing(rows, 64)
    total = sum(len(whole(t)) // 4 + 1 for _, t, *_ in ODD)
    assert sum(r.length for r in rows) == total and n >= -(-total // 64)
    for r in rows:
        assert 0 < r.length <= 64 and (r.piece == 0 or r.length == 64)
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=200), st.integers(20, 31))
def test_plan_is_as_good_as_best_fit_on_items(lengths, capacity):
    hist = {x: lengths.count(x) for x in set(lengths)}
    slots = packing.plan(hist, capacity)
    used = {}
    for s in slots:
        for k in range(s.count):
            used.setdefault(s.sequence + k, []).append((s.offset, s.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(s.count for s in slots) == len(lengths)
    assert sorted(used) == list(range(len(used)))
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    assert len(used) == len(rooms)


def test_plan_takes_counts_of_any_size():
    hist = {k: random.Random(k).randrange(10**9) for k in range(1, 1025)}
    slots = packing.plan(hist)
    assert len(slots) < 20_000 and sum(s.count for s in slots) == sum(hist.values())
    sequences = max(s.sequence + s.count for s in slots)
    assert sequences <= 1.01 * (sum(k * n for k, n in hist.items()) / 1024) + 1


def test_single_ids_of_a_written_table(spark):
    rows = [(k, f"text number {k} " * (k % 7), "en", "s", 1) for k in range(60)]
    segments = dac.write_segments(docs(spark, rows), segment_ids=200)
    every = [i for r in sorted(dac.read_documents(segments).collect(), key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4").tolist()]
    asked = [0, 1, 1, 199, 200, len(every) // 2, len(every) - 1, len(every), -1]
    got = {r.position: r.id for r in dac.tokens_at(segments, spark.createDataFrame([(x,) for x in asked], "position long")).collect()}
    assert got == {x: every[x] for x in asked if 0 <= x < len(every)} and len(got) == 6


def test_queries_of_tokens_equal_the_library(spark, sf_dir):
    """op5 and op10 by name: ids, starts and crc32 of every document against the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    library.encode_special_tokens = True
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in table}
    pack = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    seen = {d: 0 for d in ids}
    for r in sorted(queries.op5_best_fit_packing(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.piece)):
        assert r.start == seen[r.doc_id] and r.ids_crc32 == pack(ids[r.doc_id][r.start : r.start + r.length])
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in ids.items()}
    start = 0
    for r in sorted(queries.op10_token_ids(spark, sf_dir).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), pack(ids[r.doc_id]))
        start += r.n_tokens


def test_words_of_the_memo_before_are_not_merged_again(monkeypatch):
    """A word that a mark follows, or a line's end, takes its ids from both memos."""

    class Counted:
        def __init__(self, model):
            self.model, self.seen = model, []

        def tokenize(self, word):
            self.seen.append(word)
            return self.model.tokenize(word)

    monkeypatch.setattr("quernstone.llm.tokens.MEMO_ENTRIES", 2)
    encoder = ChunkEncoder(default_vocabulary())
    encoder._model = model = Counted(encoder._model)
    assert encoder.encode("x red blue green k.\nx") == whole("x red blue green k.\nx")
    model.seen.clear()
    text = "x red, blue.\nx green! red blue"
    assert encoder.encode(text) == whole(text) and model.seen == []
    long = "x " + "é" * 60 + " " + "b" * 60
    for text in (long + long[1:], long + "  " + long):
        assert encoder.encode(text) == whole(text)
    assert not encoder._memo.long and not encoder._memo.before.get("b" * 60)


def test_texts_are_merged_by_ranks_without_the_library():
    """Words, marks, lines and odd spaces take no work of the library; only texts beyond TEXT_CHARS without a cut do."""
    encoder = ChunkEncoder(default_vocabulary())
    texts = ["new words, of\nlines.\nThen it's 12 (or 3)! naïve 漢字 \U0001f600", "  two  spaces \n\t", "a, b.\n\nc d,\ne.\n x", "ſ'ſ ՘ a՘.\n࢏", "x " + "é" * 60_000]
    got = [encoder.encode(t) for t in texts]
    assert "_tokenizer" not in vars(encoder)
    assert got == [whole(t) for t in texts]
    assert encoder.encode(spaces := " " * 1_000_000 + "x") == whole(spaces)


def test_a_vocabulary_without_ranks_goes_through_the_library(tmp_path):
    import shutil

    shutil.copy(default_vocabulary(), tmp_path / "own.json")
    encoder = ChunkEncoder(str(tmp_path / "own.json"))
    for text in ("it's a word, and\nanother.\nThe  end \n", "naïve 漢字 \U0001f600 x!"):
        assert encoder.encode(text) == whole(text)


def test_ranks_make_the_merges_of_the_library():
    """Merges in the order of ids, and every token made from its own bytes: then ranks and merges give the same ids for any pre-token."""
    import json

    with open(default_vocabulary()) as f:
        model = json.load(f)["model"]
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    assert ids == sorted(set(ids)) and {*ids} | {*range(256)} == {*range(50_256)}
    library, encoder = ENCODER._tokenizer, ChunkEncoder(default_vocabulary())
    to_byte = {c: ord(library.decode([i])) for c, i in model["vocab"].items() if len(c) == 1 and len(library.decode([i])) == 1 and ord(library.decode([i])) < 128}
    for token, i in model["vocab"].items():
        if i < 50_256:
            assert [x.id for x in library.model.tokenize(token)] == [i]
            if all(c in to_byte for c in token):
                assert encoder._model.tokenize(bytes(to_byte[c] for c in token)) == [i]


def test_both_libraries_class_characters_alike():
    """Letters, digits and marks up to U+1FFFF; those beyond were compared once (no difference)."""
    import public_tokenizers
    import tiktoken

    split = ENCODER._tokenizer.pre_tokenizer.pre_tokenize_str
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for before in "a1!":
        ranks = {bytes([b]): b for b in range(256)}
        for c in every:
            ranks.setdefault((before + c).encode(), len(ranks))
        ids = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        one = [c for c in every if len(split(before + c)) == 1]
        assert one == [c for c in every if len(ids(before + c)) == 1]
        if before == "a":  # what Python takes for a letter alone may be encoded as a word
            assert {c for c in every if c.isalpha()} <= {*one}


def all_of(encoder, texts):
    ids, starts = encoder.encode_all(pa.array(texts, pa.string()), [2])
    assert len(starts) == len(texts) + 1 and starts[-1] == len(ids)
    return [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab'slt1٣,.!#\n\t  \x0b\x1c\x85\xa0\u2003　ñ漢\U0001f600̀½_Ⅷ", max_size=30), max_size=5))
def test_texts_at_once_equal_whole_texts(texts):
    assert all_of(ENCODER, texts) == [whole(t) + b"\2\0\0\0" for t in texts]


def test_texts_at_once_take_no_work_by_text_and_merge_a_word_once(monkeypatch):
    """Only texts with other spaces than single ones between words go one by one."""
    encoder, merged, alone = ChunkEncoder(default_vocabulary()), [], []
    words, encode = encoder._model.words, encoder.encode
    monkeypatch.setattr(encoder._model, "words", lambda w: (merged.extend(w.to_pylist()), words(w))[1])
    monkeypatch.setattr(encoder, "encode", lambda t: (alone.append(t), encode(t))[1])
    texts = ["the cat, the dog and\nthe cat", "a cat", None, "", "two  spaces of the cat", "a dog and\nthe cat", " x", "a" + "\n" * 100_001 + "b c"]
    assert all_of(encoder, texts) == [whole(t) + b"\2\0\0\0" for t in texts]
    assert sorted(merged) == sorted({*merged}) and {"cat,", "dog", "and\nthe", "cat"} <= {*merged} and "two" not in merged
    assert alone == ["", "", "two  spaces of the cat", " x", texts[-1]]


def test_texts_at_once_of_a_vocabulary_without_ranks(tmp_path):
    import shutil

    shutil.copy(default_vocabulary(), tmp_path / "own.json")
    texts = ["it's a word, and\nanother.", None, "The  end \n", "naïve 漢字 x!"]
    assert all_of(ChunkEncoder(str(tmp_path / "own.json")), texts) == [whole(t) + b"\2\0\0\0" for t in texts]
    assert all_of(ENCODER, []) == []


def test_slices_of_texts_hold_every_row_once():
    texts = ["a" * k for k in (0, 5, 300, 1, 2, 40, 0, 9, 500, 3)] + [None] * 30
    table = pa.table({"k": range(40), "text": pa.array(texts, pa.string())})
    for rows in (1, 7, 40):
        found = list(common.text_slices(iter(table.to_batches(max_chunksize=rows)), 100))
        assert pa.Table.from_batches(found).equals(table)
        for b in found:
            sizes = [len(t or "") + 16 for t in b.column("text").to_pylist()]
            assert sum(sizes[:-1]) < 100 and (sum(sizes) >= 100 or b is found[-1])
    assert list(common.text_slices(iter([]))) == []


def test_long_texts_are_cut_and_written_whole(spark):
    """Texts longer than a slice and than what is handed on at once, with ranks within a length that go on over both."""
    texts = ["one two " * 2, "word\n" * 900_000 + "end", None, "a few of the words " * 600_000, "three four " * 2]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    want = {k: np.frombuffer(whole(t) + b"\2\0\0\0", "<u4") for k, t in enumerate(texts)}
    cut = packing.pieces(docs(spark, rows).coalesce(1)).collect()
    for k, ids in want.items():
        own = sorted((r for r in cut if r.doc_id == k), key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and [r.piece for r in own] == list(range(len(own)))
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes() and all(len(r.ids) == 4 * r.length for r in own)
    ranks = {}
    for r in cut:
        ranks.setdefault((r.part, r.length), []).append(r.local_rank)
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
    read = {r.doc_id: r for r in dac.read_documents(dac.write_segments(docs(spark, rows))).collect()}
    assert {k: bytes(r.ids) for k, r in read.items()} == {k: x.tobytes() for k, x in want.items()}
