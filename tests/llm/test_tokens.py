"""Token counts, ids, bit packing and window packing against the tokenizers library and by round trips."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from valuegate.llm import op2_token_counts, op4_bit_packing, op5_packing  # noqa: E402
from valuegate.llm.encoding import Encoder  # noqa: E402
from valuegate.llm.pretokens import Pretokens, pieces, unknown  # noqa: E402
from valuegate.llm.transducer import Transducer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a <|endoftext|> b<|startoftext|>", "it's 'she ''s i'll've don't 12a3 ΣΑΣ İx  é é J̌", "x" * 3000, "日本語テキスト 🙂🙂'd 'dd", "\n\n'll\n", "one \U0001c893\u1c89 new \ua7ce'\ua7ce letters"]


def texts():
    random.seed(11)
    return ODD + ["".join(random.choice("ab'stre 1.é日\n") for _ in range(random.randint(0, 60))) for _ in range(500)]


def library(items):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in items], add_special_tokens=False)]


def frame(spark, items):
    rows = [(i, t, "x") for i, t in enumerate(items)] + [(None, "no id", "x"), (3, "again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_transducer_counts_as_the_library(chunk):
    machine, items = Transducer(PATH), [t for t in texts() if t and "<|" not in t]
    machine.changes = lambda symbols, f=machine.changes: f(symbols, chunk)
    got = np.zeros(len(items), int)
    for owners, parts in pieces(items, 500):
        np.add.at(got, owners, machine.counts(Pretokens(parts), len(parts)))
    assert got.tolist() == [len(x) for x in library(items)]


def test_long_pretokens_compose():
    random.seed(4)
    items = ["".join(random.choice("abcdefgh") for _ in range(random.choice([1, 7, 900, 5000]))) + " " + "x" * random.randint(0, 700) for _ in range(40)]
    for chunk in (1, 16, 256):
        machine = Transducer(PATH)
        machine.changes = lambda symbols, f=machine.changes, c=chunk: f(symbols, c)
        assert machine.counts(Pretokens(items), len(items)).tolist() == [len(x) for x in library(items)]


def test_every_assigned_or_new_code_point_gives_the_librarys_ids():
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) != "Cn" or c % 97 == 0)]
    coder, machine = Encoder(PATH), Transducer(PATH)
    for form in ("ab%scd", "%s x", "'%ss"):
        for at in range(0, len(points), 40_000):
            items = [form % chr(c) for c in points[at : at + 40_000]]
            want = library(items)
            assert [ids.tolist() for _, ids in coder.encode(items)] == want
            known = [i for i, t in enumerate(items) if not unknown(t) and "<|" not in t]
            assert machine.counts(Pretokens([items[i] for i in known]), len(known)).tolist() == [len(want[i]) for i in known]


def test_a_full_table_starts_anew():
    machine = Transducer(PATH, max_states=10)
    for t in ("hello world", "another text", "hello world"):
        assert machine.counts(Pretokens([t]), 1).tolist() == [len(library([t])[0])]


def test_encoder_with_a_small_memory():
    items = texts()
    for small in (50, 10**6):
        assert [ids.tolist() for _, ids in Encoder(PATH, small).encode(items)] == library(items)


def test_counts_query_keeps_every_row(spark):
    items = texts()
    got = op2_token_counts.token_counts(frame(spark, items), PATH).collect()
    assert len(got) == len(items) + 2
    by = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in got}
    for i, (t, ids) in enumerate(zip(items, library(items), strict=True)):
        assert by[i, len((t or "").encode())] == len(ids)
    assert op2_token_counts.token_counts(frame(spark, items).limit(0), PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = op4_bit_packing.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for start, count in ((0, 1001), (37, 11), (1000, 1), (5, 0)):
        assert (op4_bit_packing.unpack(packed, bits, start, count) == ids[start : start + count]).all()


def test_shards_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op4_bit_packing, "BLOCK_IDS", 500)
    items, folder = texts(), f"file://{tmp_path}/ids"
    op4_bit_packing.write_ids(frame(spark, items).repartition(3), folder, PATH)
    rows = op4_bit_packing.read_ids(spark, folder).orderBy("start").collect()
    assert len(rows) == len(items) + 2 and rows[0]["doc_id"] is None
    start = 0
    for r in rows:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
    want = [[*w, 1] for w in library(items)]
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    assert {k: sorted(v) for k, v in got.items()} == {None: [[*library(["no id"])[0], 1]]} | {i: sorted([w, [*library(["again"])[0], 1]] if i == 3 else [w]) for i, w in enumerate(want)}
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    # One document, and a stretch of ids, by themselves.
    some = op4_bit_packing.read_documents(spark, folder, [5, 300, 10**9]).collect()
    assert {(r["doc_id"], r["start"], bytes(r["ids"])) for r in some} == {(r["doc_id"], r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] in (5, 300)}
    every = b"".join(bytes(r["ids"]) for r in rows)
    for begin, count in ((0, 10), (777, 2500), (start - 3, 50), (5, 0), (start + 5, 3)):
        parts = op4_bit_packing.read_span(spark, folder, begin, count).orderBy("start").collect()
        assert b"".join(bytes(r["ids"]) for r in parts) == every[4 * begin : 4 * (begin + count)]


def test_shards_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, start string")
    op4_bit_packing.write_ids(empty, f"file://{tmp_path}/none", PATH)
    assert op4_bit_packing.read_ids(spark, f"file://{tmp_path}/none").count() == 0
    rows = [(None, "no id", "x")] * 40 + [(7, "one two", "x")] * 40 + [(7, None, "x"), (2**62 + 1, "", "x")]
    op4_bit_packing.write_ids(spark.createDataFrame(rows, empty.schema).repartition(5), f"file://{tmp_path}/many", PATH)
    got = op4_bit_packing.read_ids(spark, f"file://{tmp_path}/many").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 40 + [7] * 41 + [2**62 + 1]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_queries_over_whole_tables(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = dict(zip(docs, library(docs.values()), strict=True))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for r in op2_token_counts.query(spark, sf_dir).collect():
        n = len(ids[r["doc_id"]])
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 2048)
    start = 0
    by = {r["doc_id"]: r for r in op4_bit_packing.query(spark, sf_dir).collect()}
    assert by.keys() == ids.keys()
    for k in sorted(ids):
        assert (by[k]["start"], by[k]["n_tokens"], by[k]["ids_crc32"]) == (start, len(ids[k]) + 1, crc([*ids[k], 1]))
        start += len(ids[k]) + 1
    sequences, have = {}, {}
    for r in op5_packing.query(spark, sf_dir).collect():
        whole = [*ids[r["doc_id"]], 2]
        assert r["doc_tokens"] == len(whole) and r["ids_crc32"] == crc(whole[r["start"] : r["start"] + r["length"]])
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == {k: len(v) + 1 for k, v in ids.items()}
    laid(sequences, 4096)


def laid(sequences, window):
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == window or end & (end - 1) == 0


def test_packing_places_every_id_once(spark, monkeypatch):
    items = texts() + ["word " * 9000]
    want = {i: [*ids, 2] for i, ids in enumerate(library(items))}
    for most in (10_000, 1 << 24):
        monkeypatch.setattr(op5_packing, "OPEN_IDS", most)
        rows = op5_packing.pack_documents(frame(spark, items).repartition(2), PATH).collect()
        pieces_of, sequences = {}, {}
        for r in rows:
            pieces_of.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, ids in want.items():
            if i != 3:
                assert [x for _, p in sorted(pieces_of[i]) for x in p] == ids
        laid(sequences, 4096)
    assert op5_packing.pack_documents(frame(spark, items).limit(0), PATH).count() == 0


def test_sum_of_squares_chooses_the_least():
    random.seed(3)
    rule, total, out = op5_packing.SumOfSquares(16), 0, []
    for _ in range(300):
        size = random.randint(1, 15)
        for fresh in (True, False):
            level = rule.choose(size, fresh)
            squares = {}
            for h in [0, *np.flatnonzero(rule.level).tolist()]:
                if h + size <= 16 and (h or fresh):
                    after = rule.level.copy()
                    after[h] -= h > 0
                    after[h + size] += h + size < 16
                    squares[h] = int((after[1:16] ** 2).sum())
            assert squares[level] == min(squares.values()) if squares else level == 0
        out += rule.add((0, total, 0, np.arange(total, total + size)))
        total += size
    out += rule.drain()
    assert not rule.level.any() and sorted(np.concatenate([p[3] for s in out for p in s]).tolist()) == list(range(total))
    assert all(sum(len(p[3]) for p in s) in (1, 2, 4, 8, 16) for s in out)


def test_little_is_moved_at_the_end():
    rng, rule, total = np.random.default_rng(1), op5_packing.SumOfSquares(4096), 0
    for size in np.clip(rng.lognormal(5.5, 1.0, 2000), 1, 4000).astype(int):
        list(rule.add((0, 0, 0, np.zeros(size, np.int32))))
        total += size
    list(rule.drain())
    assert rule.moved < 0.02 * total


def test_crc_is_zlibs(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00"),)], "ids binary").select(F.crc32("ids"))
    assert df.first()[0] == zlib.crc32(b"\x01\x00\x00\x00")
