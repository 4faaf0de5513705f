import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexweave.llm import _common, pieces, queries, wavelet

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_pieces_equal_the_library_on_all_documents(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op2_sentencepiece(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = model.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(packed(ids)), sha(model.decode(ids).encode()))


@pytest.mark.parametrize("whole", [False, True])
def test_pieces_of_odd_texts(odd, whole):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = pieces.encode_decode(odd, PIECES, whole_texts=whole)
    assert out.columns == [c for c in odd.columns if c != "ids"] + ["ids", "decoded"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert (bytes(r["ids"]), r["decoded"]) == (packed(ids), model.decode(ids))


def test_a_model_with_crossing_pieces_is_seen():
    class Crossing:
        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    assert pieces.crossing(Crossing())
    assert not pieces.crossing(sentencepiece.SentencePieceProcessor(model_file=PIECES))


def test_token_files_equal_the_library_on_all_documents(spark, sf_dir):
    tokenizer = Tokenizer.from_file(BYTES)
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in queries.op10_token_files(spark, sf_dir).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)


@pytest.mark.parametrize("file_tokens", [50, 1 << 22])
def test_token_files_of_odd_texts(odd, file_tokens):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = wavelet.token_files(odd, BYTES, shards=3, file_tokens=file_tokens).orderBy("start").collect()
    told = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["hash"], r["text"]) for r in told.collect()))
    assert len(rows) == len(texts)
    at = 0
    for r, (there, i, _, text) in zip(rows, texts, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i if there else None, at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)


def test_byte_chunks_equal_whole_texts():
    rnd = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "a", "1", "'s", "é", "×", ".", "don't", "<|endoftext|>", "ß", "中", "word"]
    texts = ["".join(rnd.choice(parts, rnd.integers(0, 30))) for _ in range(1500)]
    encoder = wavelet.ByteEncoder(BYTES)
    assert encoder.by_chunk
    flat, ends = encoder(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == encoder.encode(texts)


@pytest.mark.parametrize("block_bits", [64, 512, wavelet.BLOCK_BITS])
def test_wavelet_matrix_access_rank_select(block_bits):
    rnd = np.random.default_rng(2)
    for values in (rnd.integers(0, 50_257, 3000), np.zeros(70, int), np.array([70_000, 3, 70_000]), np.zeros(0, int), np.arange(512), np.arange(128) % 2):
        values = values.astype(np.uint32)
        opened = wavelet.TokenFile.of_bytes(wavelet.pack(values, [1, None], np.array([len(values) // 2, len(values)]), block_bits=block_bits))
        matrix = opened.matrix
        assert opened.doc_ids == [1, None] and opened.ends.tolist() == [len(values) // 2, len(values)]
        assert (matrix.decode_all() == values).all() and (matrix.access(np.arange(len(values))) == values).all()
        assert (opened.document(1) == values[len(values) // 2 :]).all()
        with pytest.raises(IndexError):
            matrix.access(len(values))
        for i in range(0, len(values), 97):
            v = int(values[i])
            assert matrix.access(i) == v and matrix.rank(v, i) == (values[:i] == v).sum()
            assert matrix.occurrences(v) == np.flatnonzero(values == v).tolist()
        assert matrix.count(99_999, 0, len(values)) == 0 and matrix.select(99_999, 0) == -1


def test_random_access_reads_little():
    values = np.random.default_rng(3).integers(0, 50_000, 1 << 20).astype(np.uint32)
    data = wavelet.pack(values, [1], np.array([len(values)]))
    read = []
    opened = wavelet.TokenFile(lambda at, length: read.append(length) or data[at : at + length])
    assert opened.matrix.access(777_777) == values[777_777] and opened.matrix.count(int(values[5]), 0, 900_000) == (values[:900_000] == values[5]).sum()
    assert sum(read) < 0.9 * len(data) and opened.matrix.blocks == 4
    small = wavelet.TokenFile(lambda at, length: data[at : at + length])
    small_read = []
    small.matrix.block = lambda level, k, plain=small.matrix.block: small_read.append(k) or plain(level, k)
    small.matrix.access(5)
    assert len(small_read) <= 2 * len(small.matrix.zeros)


def test_lookups_in_the_files(spark, sf_dir):
    """Access, counts and occurrences over all files of all documents against the library's ids."""
    tokenizer = Tokenizer.from_file(BYTES)
    docs = queries.table(spark, sf_dir, "documents")
    folder = wavelet.new_folder(spark, "lookups")
    manifest = wavelet.write_files(docs, folder, BYTES, shards=3, file_tokens=20_000)
    told = wavelet.read_documents(spark, folder, manifest).withColumn("first", F.min("start").over(Window.partitionBy("file"))).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    assert len({r["file"] for r in told}) == 3
    wanted, want = [], set()
    for r in told:
        for k in range(0, r["n_tokens"], 50):
            wanted.append((r["file"], r["start"] - r["first"] + k))
            want.add((*wanted[-1], ids[r["doc_id"]][k]))
    assert {tuple(r) for r in wavelet.tokens_at(spark.createDataFrame(wanted, "file string, place long"), folder).collect()} == want
    some = [2, *ids[told[0]["doc_id"]][:3], 50_000]
    counts = {}
    for r in told:
        for t in set(some):
            counts[r["file"], t] = counts.get((r["file"], t), 0) + ids[r["doc_id"]].count(t)
    assert {(r["file"], r["token"]): r["n"] for r in wavelet.token_counts(manifest, folder, some).collect()} == counts
    for t in some[1:3]:
        found = {(r["doc_id"], r["at"]) for r in wavelet.token_occurrences(manifest, folder, t, batch_rows=7).collect()}
        assert found == {(i, k) for i, x in ids.items() for k, y in enumerate(x) if y == t}


def test_hot_and_null_ids_fill_several_ranges(spark):
    """A third of the rows without an id and a third of one id: no range holds much more than its share."""
    rows = [(None, f"no id {i}") for i in range(1000)] + [(7, f"one id {i}") for i in range(1000)] + [(100 + i, f"own id {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    ranges = _common.id_ranges(df, "doc_id", 30)
    placed = df.withColumn("bin", ranges.of(F.col("doc_id"), F.col("hash"))).collect()
    sizes = Counter(r["bin"] for r in placed)
    assert max(sizes.values()) <= 200 and max(sizes) < ranges.count and len(sizes) >= 28
    order = sorted(placed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["hash"]))
    assert [r["bin"] for r in order] == sorted(r["bin"] for r in placed)
    many = _common.id_ranges(df, "doc_id", 400)
    assert [r["b"] for r in df.withColumn("b", many.of(F.col("doc_id"), F.col("hash"))).orderBy(F.asc_nulls_first("doc_id"), "hash").collect()] == sorted(r["b"] for r in df.withColumn("b", many.of(F.col("doc_id"), F.col("hash"))).collect())


def test_empty_tables(empty):
    assert pieces.encode_decode(empty, PIECES).count() == 0
    assert wavelet.token_files(empty, BYTES).count() == 0
    assert wavelet.token_files(empty, BYTES).select(F.sum("n_tokens")).first()[0] is None
