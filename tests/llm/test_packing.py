"""Packing: the ids are the tokenizer's, every id lies in one piece, sequences are gapless and hardly padded."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from folianth.llm import packing

from .common import LONG, documents, empty, rows


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def ids_of(t, text):
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(pieces, texts, size):
    """Pieces of rows (doc_id, text) whose ids are unique."""
    t = tokenizer()
    ids = {i: ids_of(t, x) for i, x in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == len(ids[i])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding


def test_encoder_is_the_tokenizer():
    t, e = tokenizer(), packing.Encoder(packing.tokenizer_path())
    texts = ["", LONG, "Straße ÀÉÖ!! ÿ... x`y it's we'll d'o ö̈ naïve-été; K ı İ ÷ × µ ª", "a<|endoftext|>b <|startoftext|>", "1234 a1b2 3.14\tx y z\x1c\x0b", "\U0001f600 ΑΣ ΣΑΣ и Й", "don't 'tis (x), [y]; {z} ~ ## ### $$$ %% a.b.c"]
    for x in texts:
        assert e.ids(x) == ids_of(t, x)[:-1].tobytes()


@pytest.mark.parametrize("size, quantum", [(4096, 64), (64, 8)])
def test_packing(spark, size, quantum):
    data = [(i, r[1]) for i, r in enumerate(rows())]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), sequence=size, quantum=quantum).collect()
    assert check(got, data, size) == 0


def test_cut_pieces_by_join(spark):
    data = [(i, f"{LONG} " * (i % 7 + 1)) for i in range(60)]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), sequence=128, quantum=16).collect()
    assert check(got, data, 128) == 0


def test_repeated_rows_and_null_ids(spark):
    got = packing.pack(documents(spark), sequence=64, quantum=8).collect()
    t = tokenizer()
    assert sum(p.length for p in got) == sum(len(ids_of(t, r[1])) for r in rows())
    assert all(p.ids_crc32 is not None for p in got)
    assert packing.pack(empty(spark)).count() == 0


def test_cutting_stock_meets_its_bound():
    lengths, demand = np.array([3, 5, 7, 16, 32, 48]), np.array([900, 700, 300, 500, 400, 600])
    plan = packing.cutting_stock(lengths, demand, 64)
    used = plan.patterns.T @ plan.times
    assert (used <= demand).all() and (plan.patterns @ lengths == 64).all()
    assert plan.times.sum() >= (lengths * demand).sum() / 64 - len(lengths) - 1


def test_knapsack_equals_search():
    lengths, worth = np.array([3, 4, 7]), np.array([0.31, 0.4, 0.75])
    value, pattern = packing.knapsack(lengths, worth, 20)
    best = max(a * 0.31 + b * 0.4 + c * 0.75 for a in range(7) for b in range(6) for c in range(3) if 3 * a + 4 * b + 7 * c <= 20)
    assert np.isclose(value, best) and np.isclose(pattern @ worth, best) and pattern @ lengths <= 20


def test_other_tokenizers_take_their_whole_way(tmp_path):
    """One that doesn't lower-case and splits on marks, and one that keeps blanks in its ids."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    texts = ["Hello, World hello", "a b  a\nb", "", "world!"]
    vocabulary = {x: i for i, x in enumerate(["[UNK]", "Hello", "hello", ",", "World", "world", "a", "b", "!"])}
    parting = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))
    parting.pre_tokenizer = pre_tokenizers.Whitespace()
    keeping = Tokenizer(models.WordLevel({**vocabulary, " ": 9, "a b": 10}, unk_token="[UNK]"))
    for k, t in enumerate((parting, keeping)):
        path = str(tmp_path / f"{k}.json")
        t.save(path)
        e = packing.Encoder(path)
        for x in texts:
            want = np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() if x else b""
            assert e.ids(x) == want
        data = [x.encode() for x in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
        found, row = e.batch(np.frombuffer(b"".join(data), np.uint8), at)
        assert [found[i:j].astype("<u4").tobytes() for i, j in zip(row[:-1], row[1:])] == [e.ids(x) for x in texts]


def test_ranks_of_many_pieces(spark, monkeypatch):
    """Ranks count each length from 0 without gaps, whatever the groups."""
    monkeypatch.setattr(packing, "RANKED", 10)
    df = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "id AS th", "id % 3 AS length")
    got = packing.ranked(df).collect()
    for length in range(3):
        assert sorted(r["rank"] for r in got if r.length == length) == list(range(1000))
