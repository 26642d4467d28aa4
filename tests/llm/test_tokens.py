import glob
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from palimpsest.llm import encoding, token_ids
from palimpsest.llm.encoding import encoder
from palimpsest.llm.packing import binary_lengths, pack
from palimpsest.llm.token_ids import read_token_ids, token_checksums, write_token_ids
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aB zé,.|\n\t '0İ́ß \x1c<|end>")), max_size=30), max_size=4))
def test_encoder_equals_whole_texts(path, found):
    whole = Tokenizer.from_file(path)
    ids = [whole.encode(t, add_special_tokens=False).ids for t in found]
    got, offsets = encoder(path).encode(pa.array(found, pa.string()))
    assert [got[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == ids
    got, offsets = encoder(path).encode(pa.array(found, pa.string()), 2)
    assert [got[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*x, 2] for x in ids]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_forgotten_pieces_are_learned_again(path, monkeypatch):
    monkeypatch.setattr(encoding, "KEPT", 50)
    held, whole = encoding.Encoder(path), Tokenizer.from_file(path)
    for n in range(0, 400, 7):
        found = [" ".join(f"w{i}x a{i % 9}, end." for i in range(n % 60, n % 60 + 12)), None, f"line {n}\nnext  two"]
        got, offsets = held.encode(pa.array(found, pa.string()))
        assert [got[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in found]


def test_orc_round_trip(spark, docs, tmp_path):
    write_token_ids(docs, f"{tmp_path}/t", BYTES)
    rows = read_token_ids(spark, f"{tmp_path}/t").collect()
    t = Tokenizer.from_file(BYTES)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    assert len(rows) == len(want)
    start = 0
    for r, (_, doc_id, text) in zip(sorted(rows, key=lambda r: r.start), want):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id or 0, r.start, r.n_tokens, r.tokens) == (doc_id, start, len(ids), ids)
        start += len(ids)
    sums = {(r.start): r.ids_crc32 for r in token_checksums(read_token_ids(spark, f"{tmp_path}/t")).collect()}
    assert sums == {r.start: crc(r.tokens) for r in rows}


def test_orc_of_no_rows(spark, none, tmp_path):
    write_token_ids(none, f"{tmp_path}/t", BYTES)
    assert read_token_ids(spark, f"{tmp_path}/t").count() == 0


def test_orc_prunes_by_id(spark, docs, tmp_path):
    write_token_ids(docs, f"{tmp_path}/t", BYTES)
    plan = spark.read.orc(f"{tmp_path}/t").filter("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan


def test_orc_files_hold_indexes_and_prune(spark, tmp_path, monkeypatch):
    """Row indexes and Bloom filters on doc_id are in every stripe, and a lookup reads no more than one stride of one file."""
    rows = spark.range(0, 9_000, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    monkeypatch.setattr(token_ids, "STRIDE", 1_000)
    write_token_ids(rows, f"{tmp_path}/t", BYTES)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = sorted(glob.glob(f"{tmp_path}/t/*.orc"))
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        held = reader.rows()
        for stripe in reader.getStripes():
            streams = [s for s in held.readStripeFooter(stripe).getStreamsList()]
            assert [s for s in streams if s.getKind().toString() == "BLOOM_FILTER_UTF8" and s.getColumn() == 1]
            assert [s for s in streams if s.getKind().toString() == "ROW_INDEX" and s.getColumn() == 1]
        assert reader.getRowIndexStride() == 1_000
    found = spark.read.schema(token_ids.STORED).orc(f"{tmp_path}/t").filter("doc_id = 4500")
    assert [r.doc_id for r in found.collect()] == [4_500] and found.select("doc_id").distinct().count() == 1
    absent = spark.read.schema(token_ids.STORED).orc(f"{tmp_path}/t").filter("doc_id = 4501")
    assert absent.count() == 0


@pytest.mark.parametrize("wide", [True, False])
def test_clashing_columns_and_long_texts(spark, tmp_path, wide):
    long = "über " * 60_000 + "x" * 50_000
    docs = spark.createDataFrame([(2, long), (1, None), (1, None), (None, "")], "doc_id long, text string")
    if wide:
        docs = docs.withColumns({"tokens": F.lit(1), "range": F.lit("r"), "start": F.lit(2), "n_tokens": F.lit(3), "length": F.lit(4), "split": F.lit(5)})
    write_token_ids(docs, f"{tmp_path}/t", BYTES)
    t = Tokenizer.from_file(BYTES)
    assert sorted(r.n_tokens for r in read_token_ids(spark, f"{tmp_path}/t").collect()) == [1, 1, 1, len(t.encode(long, add_special_tokens=False).ids) + 1]
    packed = pack(docs, WORDS, with_tokens=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {None: 1, 1: 2, 2: len(Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids) + 1}


@given(st.integers(1, 10**6))
def test_lengths_add_up(n):
    found = binary_lengths(n, 4096)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 4096 for x in found) and found == sorted(found, reverse=True)


@pytest.mark.parametrize("longest", [16, 4096])
def test_pack_covers_every_id_once(spark, docs, longest):
    rows = pack(docs, WORDS, longest=longest).collect()
    t = Tokenizer.from_file(WORDS)
    want = sorted(tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    pieces = {}
    for r in rows:
        assert r.offset == 0 and r.length == len(r.tokens) <= longest and r.ids_crc32 == crc(r.tokens)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.tokens))
    assert sum(len(r.tokens) for r in rows) == sum(map(len, want))
    assert len({r.sequence_id for r in rows}) == len(rows)
    whole = [tuple(i for _, p in sorted(x, key=lambda y: y[0]) for i in p) for (d, n), x in pieces.items() if sum(len(p) for _, p in x) == n]
    assert set(whole) <= set(want)
    by_length = {}
    for r in rows:
        by_length.setdefault(r.length, []).append(r.sequence_id)
    assert all(max(ids) - min(ids) + 1 == len(ids) for ids in by_length.values())


def test_pack_of_no_rows(none):
    assert pack(none, WORDS).count() == 0
