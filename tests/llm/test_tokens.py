import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import gather, messy_rows, table
from tickframe.llm import packing, token_store
from tickframe.llm.encode import END, TOKENIZER, Encoder, encoder


def library_ids(text):
    return encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids + [END]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzZ'’.,!?<|>sStTrReE 0123\n\t\x0b\x1c\x85\xa0éÉßİıǰJ̱̌́̈Σσς"), st.characters(
    exclude_categories=["Cs"])), max_size=40))
def test_encoder_agrees_with_the_library(text):
    got = encoder(TOKENIZER).ids(text.encode())
    assert [*struct.unpack(f"<{len(got) // 4}I", got), END] == library_ids(text)


def test_encoder_forgets_when_full():
    small = Encoder(remembered=3)
    for _ in range(2):
        for _, t in messy_rows()[-13:]:
            got = small.ids((t or "").encode())
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) + [END] == library_ids(t)


def test_packing_leaves_memory_to_what_follows_it():
    enc = Encoder(remembered=packing.REMEMBERED)
    enc.known.find = lambda word: word
    for i in range(1_000_000):
        assert enc.known[b"%d" % i] == b"%d" % i
    assert len(enc.known) + len(enc.known.older) <= 200_000


def test_encoder_keeps_words_that_come_again():
    enc, asked = Encoder(remembered=20), Counter()

    class Model:
        def tokenize(self, word):
            asked[word] += 1
            return enc.tokenizer.model.tokenize(word)

    enc.model = Model()
    for n in range(200):
        rare = f"{chr(97 + n // 26)}{chr(97 + n % 26)}x"
        assert enc.ids(f"often {rare}".encode()) == b"".join(map(enc.ids, (b"often", rare.encode())))
    assert asked["often"] == 1


def test_encoder_gives_a_batch_as_its_texts():
    texts = [t for _, t in messy_rows()] + ["", None, "Word$$$ word,*** (word) <|endoftext|>!! <|endoftext|>", "\x0b\x0c a\x1cb "]
    for kind in (pa.string(), pa.large_string()):
        got = encoder(TOKENIZER).all_ids(pa.array(texts, kind).slice(1))
        assert [[*struct.unpack(f"<{len(g) // 4}I", g), END] for g in got] == [library_ids(t) for t in texts[1:]]
    assert encoder(TOKENIZER).all_ids(pa.array([], pa.string())) == []


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1, 0], list(range(5000)), [7] * 1500, [70000] * 1500])
def test_codes_give_any_id(ids):
    shard = token_store.TokenShard(token_store.pack_ids(np.array(ids, np.uint32)))
    assert len(shard) == len(ids) and shard.ids().tolist() == ids
    assert [shard[i] for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        shard[len(ids)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1200))
def test_codes_round_trip(ids):
    shard = token_store.TokenShard(token_store.pack_ids(np.array(ids, np.uint32)))
    assert shard.ids().tolist() == ids and all(shard[i] == ids[i] for i in range(0, len(ids), 7))


@pytest.mark.parametrize("size", [1, 500, 1 << 20])
def test_token_store(spark, tmp_path, size):
    rows = [r for r in messy_rows() if r[0] is not None and r[0] != 2003]
    token_store.write_token_store(table(spark, rows), str(tmp_path / "s"), shard=size)
    want, at = set(), 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = library_ids(t)
        want.add((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert set(gather(token_store.read_documents(spark, str(tmp_path / "s")))) == want
    shard = spark.read.parquet(str(tmp_path / "s")).orderBy("part", "shard").first()
    assert token_store.TokenShard(bytes(shard["payload"]))[0] == library_ids(min(rows)[1])[0]


def test_token_store_with_ties_and_nulls(spark, tmp_path):
    rows = messy_rows()
    token_store.write_token_store(table(spark, rows), str(tmp_path / "s"))
    got = gather(token_store.read_documents(spark, str(tmp_path / "s")))
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(i), crc(i)) for d, i in ((d, library_ids(t)) for d, t in rows))
    spans = sorted((s, s + n) for _, s, n, _ in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [s for d, s, _, _ in got if d is None][0] < min(s for d, s, _, _ in got if d is not None)


def test_token_store_empty(spark, tmp_path):
    token_store.write_token_store(table(spark, []), str(tmp_path / "s"))
    assert gather(token_store.read_documents(spark, str(tmp_path / "s"))) == []


def best_fit_by_hand(lengths, window):
    room = []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits)[1]
        else:
            room.append(window)
            i = len(room) - 1
        room[i] -= n
    return room


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    number, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    room = best_fit_by_hand(lengths, 64)
    got = defaultdict(int)
    for n, o, w in zip(number, offset, lengths):
        assert got[n] == o
        got[n] += w
    assert sorted(got.values()) == sorted(64 - r for r in room)


@pytest.mark.parametrize("window,per_shard", [(4096, 8192), (64, 16)])
def test_packing(spark, window, per_shard):
    rows = messy_rows()
    got = packing.pack_documents(table(spark, rows), window=window, per_shard=per_shard)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    want = Counter()
    for d, t in rows:
        ids = library_ids(t)
        want.update((d, s, len(ids[s:s + window]), crc(ids[s:s + window]), len(ids)) for s in range(0, len(ids), window))
    got = gather(got)
    assert Counter(r[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r[5]].append((r[6], r[2]))
    for v in held.values():
        assert sum(n for _, n in v) <= window
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))]


def test_sequences_hold_all_ids(spark):
    rows = messy_rows()
    got = gather(packing.sequences(table(spark, rows), window=128, per_shard=32))
    assert all(n == len(ids) // 4 <= 128 for _, n, ids in got)
    every = Counter(i for _, _, ids in got for i in struct.unpack(f"<{len(ids) // 4}I", ids))
    assert every == Counter(i for _, t in rows for i in library_ids(t))


def test_packing_empty(spark):
    assert gather(packing.pack_documents(table(spark, []))) == []
