"""Token ids as wavelet-matrix files: one compressed file a shard, in ascending doc_id order.

A file holds the bit planes of a wavelet matrix over all ids of the shard's documents and the documents' ids and ends. A plane is
cut into blocks that are compressed one by one, and a stored directory tells where each block stands and how many ones are
before it. Access to a token, counts of an id in a span and the place of its k-th occurrence so read the header and a few blocks
of the one file, never all of it.

File format (little-endian): b"LXW2", unsigned 32-bit length of the header, header (JSON: n, docs, zeros of each plane, bits of a
block, byte lengths of the parts), then the parts: doc ids (int64), doc id nulls (packed bits), ends (uint64), alphabet (uint32),
directory (uint32: compressed bytes, then ones, of each block of each plane), then the blocks of the planes from the top bit
(packed bits). Every part and every block is a zstandard frame.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import chunk_array, id_ranges, joined_back, new_folder, put_in_place, quoted, release_memory, running_in_bins, stored, text_buffers, text_slices

MAGIC = b"LXW2"
#: A file is closed once it holds this many ids; a document is never cut, so a longer one makes a larger file.
FILE_TOKENS = 1 << 22
#: Bits of a plane that are compressed together; a multiple of 64.
BLOCK_BITS = 1 << 18
#: Blocks that an open file keeps.
HELD_BLOCKS = 256


class WaveletMatrix:
    """Rank and select over a sequence of unsigned integers, kept as one packed bit plane for each bit of their ranks in the
    alphabet, which holds the distinct integers in ascending order. block(level, k) gives the bytes of a plane's k-th block, and
    ones how many ones each block holds; blocks are asked for when they are needed."""

    def __init__(self, n: int, zeros: list[int], alphabet: np.ndarray, ones: np.ndarray, block_bits: int, block: Callable[[int, int], bytes]):
        self.n, self.zeros, self.alphabet, self.block_bits, self.block = n, zeros, alphabet, block_bits, block
        self.before = np.concatenate((np.zeros((len(zeros), 1), np.int64), np.cumsum(ones, axis=1, dtype=np.int64)), axis=1)
        self.held: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    @classmethod
    def build(cls, values: np.ndarray, block_bits: int = BLOCK_BITS) -> WaveletMatrix:
        there = np.bincount(values) > 0 if len(values) else np.zeros(0, bool)
        alphabet = np.flatnonzero(there)
        top = max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        kind = np.uint16 if top <= 16 else np.uint32
        row = (np.cumsum(there) - 1).astype(kind)[values] if len(values) else np.zeros(0, kind)
        planes, zeros = [], []
        starts = np.arange(0, len(values), block_bits)
        ones = np.zeros((top, len(starts)), np.int64)
        for level, bit in enumerate(range(top - 1, -1, -1)):
            one = (row & row.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(one, bitorder="little").tobytes())
            if len(starts):
                ones[level] = np.add.reduceat(one, starts, dtype=np.int64)
            # by places, which is several times as fast as by mask
            low = np.take(row, np.flatnonzero(~one))
            zeros.append(len(low))
            row = np.concatenate((low, np.take(row, np.flatnonzero(one))))
        size = block_bits // 8
        return cls(len(values), zeros, alphabet, ones, block_bits, lambda level, k: planes[level][k * size : (k + 1) * size])

    @property
    def blocks(self) -> int:
        return self.before.shape[1] - 1

    def decode_all(self) -> np.ndarray:
        """The whole sequence: each plane's stable split is undone from the lowest bit up."""
        depth = len(self.zeros)
        row = np.zeros(self.n, np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth - 1, -1, -1):
            plane = np.frombuffer(b"".join([self.block(level, k) for k in range(self.blocks)]), np.uint8)
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~one)] = row[: self.zeros[level]]
            up[np.flatnonzero(one)] = row[self.zeros[level] :] | row.dtype.type(1 << (depth - 1 - level))
            row = up
        return self.alphabet.astype(np.uint32)[row] if self.n else np.zeros(0, np.uint32)

    def _words(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block, with one more that is 0, and the ones before each of them."""
        if (level, k) not in self.held:
            data = self.block(level, k)
            words = np.zeros(len(data) // 8 + 2, "<u8")
            words.view(np.uint8)[: len(data)] = np.frombuffer(data, np.uint8)
            self.held[level, k] = words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            if len(self.held) > HELD_BLOCKS:
                self.held.popitem(last=False)
        self.held.move_to_end((level, k))
        return self.held[level, k]

    def _rank1(self, level: int, places: np.ndarray) -> np.ndarray:
        """The ones before each place of a plane."""
        out = np.empty(len(places), np.int64)
        block, rest = np.divmod(places, self.block_bits)
        for k in np.unique(block).tolist():
            mine = block == k
            if k == self.blocks:
                out[mine] = self.before[level, k]
                continue
            words, ones = self._words(level, k)
            word, bit = rest[mine] >> 6, (rest[mine] & 63).astype(np.uint64)
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[mine] = self.before[level, k] + ones[word] + np.bitwise_count(below)
        return out

    def access(self, places: np.ndarray | int) -> np.ndarray | int:
        """The integers at places."""
        at = np.atleast_1d(np.asarray(places, np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(f"a place is outside 0..{self.n - 1}")
        value = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._rank1(level, at)
            bit = self._rank1(level, at + 1) - ones
            value = value << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        out = self.alphabet[value] if len(at) else np.zeros(0, np.int64)
        return out if np.ndim(places) else int(out[0])

    def _rank_of(self, value: int) -> int:
        at = int(np.searchsorted(self.alphabet, value))
        return at if at < len(self.alphabet) and self.alphabet[at] == value else -1

    def _span(self, value: int, a: int, b: int) -> tuple[int, int]:
        value = self._rank_of(value)
        if value < 0:
            return 0, 0
        at = np.array([a, b], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._rank1(level, at)
            at = zeros + ones if value >> (len(self.zeros) - 1 - level) & 1 else at - ones
        return int(at[0]), int(at[1])

    def rank(self, value: int, i: int) -> int:
        """How often value stands before place i."""
        return self.count(value, 0, i)

    def count(self, value: int, a: int, b: int) -> int:
        lo, hi = self._span(value, a, b)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of value, from 0; -1 if there are fewer."""
        lo, hi = self._span(value, 0, self.n)
        return self._up(value, lo + k) if 0 <= k < hi - lo else -1

    def _up(self, value: int, at: int) -> int:
        """The place in the sequence of a place in the last order."""
        value = self._rank_of(value)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        before = self.before[level] if bit else np.minimum(np.arange(self.blocks + 1) * self.block_bits, self.n) - self.before[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        k -= int(before[block])
        words, ones = self._words(level, block)
        inside = ones if bit else np.arange(len(ones)) * 64 - ones
        word = int(np.searchsorted(inside, k, side="right")) - 1
        k -= int(inside[word])
        bits = np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little")
        return block * self.block_bits + word * 64 + int(np.flatnonzero(bits == bit)[k])

    def occurrences(self, value: int) -> list[int]:
        lo, hi = self._span(value, 0, self.n)
        return [self._up(value, at) for at in range(lo, hi)]


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, level: int = 1, block_bits: int = BLOCK_BITS) -> bytes:
    """One shard as the bytes of its file."""
    import zstandard

    matrix = WaveletMatrix.build(ids, block_bits)
    packer = zstandard.ZstdCompressor(level=level)
    blocks = [[packer.compress(matrix.block(i, k)) for k in range(matrix.blocks)] for i in range(len(matrix.zeros))]
    directory = np.stack((np.array([[len(x) for x in plane] for plane in blocks], "<u4").reshape(len(blocks), -1), np.diff(matrix.before).astype("<u4")))
    none = np.array([x is None for x in doc_ids], bool)
    parts = [np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), np.packbits(none).tobytes(), ends.astype("<u8").tobytes(), matrix.alphabet.astype("<u4").tobytes(), directory.tobytes()]
    frames = [packer.compress(p) for p in parts]
    header = json.dumps({"n": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "block_bits": block_bits, "parts": [len(f) for f in frames]}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(header)), header, *frames, *(x for plane in blocks for x in plane)))


class TokenFile:
    """A file opened over read(offset, length): matrix, doc_ids and ends (of each document). Blocks are read when needed."""

    def __init__(self, read: Callable[[int, int], bytes]):
        import zstandard

        opener = zstandard.ZstdDecompressor()
        head = bytes(read(0, 8))
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack_from("<I", head, 4)
        header, at, parts = json.loads(bytes(read(8, size))), 8 + size, []
        for length in header["parts"]:
            parts.append(opener.decompress(read(at, length)))
            at += length
        none = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=header["docs"])
        self.doc_ids = [None if gone else x for x, gone in zip(np.frombuffer(parts[0], "<i8").tolist(), none.tolist(), strict=True)]
        self.ends = np.frombuffer(parts[2], "<u8").astype(np.int64)
        sizes, ones = np.frombuffer(parts[4], "<u4").astype(np.int64).reshape(2, len(header["zeros"]), -1)
        offsets = at + np.concatenate(([0], np.cumsum(sizes.ravel())))

        def block(level: int, k: int) -> bytes:
            i = level * sizes.shape[1] + k
            return opener.decompress(read(int(offsets[i]), int(sizes[level, k])))

        self.matrix = WaveletMatrix(header["n"], header["zeros"], np.frombuffer(parts[3], "<u4"), ones, header["block_bits"], block)

    @classmethod
    def of_bytes(cls, data: bytes) -> TokenFile:
        return cls(lambda at, length: data[at : at + length])

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.matrix.access(np.arange(self.ends[k - 1] if k else 0, self.ends[k]))


#: Kinds of bytes: 1 ASCII white space as the splitter sees it, 2 ASCII letters.
_KINDS = np.array([1 if b == 0x20 or 0x09 <= b <= 0x0D or 0x1C <= b <= 0x1F else 2 if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0 for b in range(256)], np.uint8)
#: First bytes of the white space beyond ASCII in UTF-8 (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000). Fixed values of Unicode.
_WIDE = ((b"\xc2", (b"\x85", b"\xa0")), (b"\xe1", (b"\x9a",)), (b"\xe2", (b"\x80", b"\x81")), (b"\xe3", (b"\x80",)))


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one of those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in set(plain)]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


class ByteEncoder:
    """Texts to ids of a byte-level BPE file. Its splitter never joins white space to what stands before, and ends a run of
    letters before anything else, so a text is cut before each run of white space and behind each run of Latin letters, and each
    distinct piece of a slice is encoded once. A piece that is one word goes straight to the library's BPE model, any other
    through the whole tokenizer. Texts with white space beyond ASCII or with a special token's string are encoded whole."""

    def __init__(self, tokenizer_path: str, special_strings_as_text: bool = False, known_words: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = special_strings_as_text
        self.known: dict[str, list[int]] = {}
        self.known_words = known_words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        split = kind.get("pre_tokenizer") or {}
        self.by_chunk = split.get("type") == "ByteLevel" and kind["normalizer"] is None and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.letters = byte_letters()
        self.space = chr(self.letters[0x20])

    def encode(self, texts: list[str]) -> list[list[int]]:
        # one call for each: the library's own threads would take the cores of other tasks
        return [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def of_word(self, word: str) -> list[int]:
        body = word[1:] if word[0] == " " else word
        if not body.isalpha():
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        told = (self.space + body if word[0] == " " else word) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(told)]

    def of_words(self, words: list[str]) -> list[list[int]]:
        known, out = self.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.of_word(w)
                if len(w) <= 20 and len(known) < self.known_words:  # a bounded memory; frequent words come early
                    known[w] = ids
            out.append(ids)
        return out

    def _whole(self, texts: pa.StringArray, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        whole = np.zeros(len(texts), bool)
        raw = data.tobytes()
        for lead, seconds in _WIDE:
            if lead in raw:
                at = np.flatnonzero(data[:-1] == lead[0])
                at = at[np.isin(data[at + 1], [x[0] for x in seconds])]
                whole[np.searchsorted(rows, at, side="right") - 1] = True
        for special in self.special:
            if special.encode() in raw:
                whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        return whole

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and where each text begins (with the end)."""
        data, rows = text_buffers(texts)
        whole = self._whole(texts, data, rows) if self.by_chunk else np.ones(len(texts), bool)
        if not whole.any():
            return self.chunked(data, rows)
        lists: list = [None] * len(texts)
        for i, x in zip(np.flatnonzero(whole).tolist(), self.encode(texts.filter(pa.array(whole)).to_pylist()), strict=True):
            lists[i] = x
        flat, ends = self.chunked(*text_buffers(pa.concat_arrays([texts.filter(pa.array(~whole))])))
        for k, i in enumerate(np.flatnonzero(~whole).tolist()):
            lists[i] = flat[ends[k] : ends[k + 1]].tolist()
        return joined_back(lists, np.arange(len(texts)))

    def chunked(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        kinds = _KINDS[data]
        space, letter = kinds == 1, kinds == 2
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        # the accented Latin letters end a run of letters as well; beside them stand two signs
        last = letter[:-1].copy()
        last[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        begins[1:] |= last & ~letter[1:] & (data[1:] < 0x80)
        begins[rows[:-1][np.diff(rows) > 0]] = True
        starts = np.flatnonzero(begins)
        table = chunk_array(data, starts).dictionary_encode()
        ids = self.of_words(table.dictionary.to_pylist())
        flat, ends = joined_back(ids, table.indices.to_numpy(zero_copy_only=False))
        return flat, ends[np.searchsorted(starts, rows)]


@lru_cache(maxsize=1)
def byte_encoder(tokenizer_path: str, special_strings_as_text: bool) -> ByteEncoder:
    """One encoder for all tasks of a Python worker, so that the words it knows are known to the next task."""
    return ByteEncoder(tokenizer_path, special_strings_as_text)


def write_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, file_tokens: int = FILE_TOKENS, special_strings_as_text: bool = False) -> DataFrame:
    """Encodes every whole text of df, appends end_id to each document and writes the ids as wavelet-matrix files of folder, in
    ascending id_col order over the files' names. Gives a stored table of the files: file, docs, tokens, bytes.

    Null ids come first, equal ids are ordered by the hash of their text, a null text is the empty one (only the end id), other
    columns are not used. An empty df gives no file. A file is written under a name of its own and then renamed, so a repeated
    task leaves the same file once. Shards are (id, text hash) ranges of near equal row counts, by default about as many as the
    session's shuffle partitions; an id that many rows share, or none, fills several. A task holds the ids of one file, never a
    shard of unknown size."""
    manifest = "file string, docs long, tokens long, bytes long"
    rows = df.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ranges = id_ranges(rows, "doc_id", shards)
    shard = ranges.of(F.col("doc_id"), F.col("hash")).cast("int")
    ordered = rows.repartitionById(ranges.count, shard).sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        shard, part = TaskContext.get().partitionId(), 0
        encoder = byte_encoder(tokenizer_path, special_strings_as_text)
        held, docs, lengths, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, docs, lengths, total, part
            data = pack(np.concatenate(held), docs, np.cumsum(np.array(lengths, np.int64)))
            name = f"shard-{shard:06d}-{part:06d}.lxwm"
            with store.open_output_stream(own := f"{root}/.{name}.{uuid.uuid4().hex}") as out:
                out.write(data)
            put_in_place(store, own, f"{root}/{name}")
            row = {"file": [name], "docs": [len(docs)], "tokens": [total], "bytes": [len(data)]}
            held, docs, lengths, total, part = [], [], [], 0, part + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in text_slices(batch.column(1), 8 << 20):
                flat, ends = encoder(texts)
                sizes = np.diff(ends) + 1
                with_end = np.full(len(flat) + len(texts), end_id, flat.dtype)
                mask = np.ones(len(with_end), bool)
                mask[np.cumsum(sizes) - 1] = False
                with_end[np.flatnonzero(mask)] = flat
                held.append(with_end.astype(np.uint16) if not len(flat) or flat.max() < 1 << 16 else with_end)
                docs += ids[at : at + len(texts)]
                lengths += sizes.tolist()
                total += len(with_end)
                if total >= file_tokens:
                    yield close()
        if docs:
            yield close()
        release_memory()

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return stored(ordered.mapInArrow(run, manifest), "wavelet-manifest")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, file, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned,
    over the ids as little-endian unsigned 32-bit integers). The files' running starts
    are distributed prefix sums of the manifest, which holds one row a file."""
    numbered = manifest.withColumn("bin", F.floor(F.regexp_extract("file", r"^shard-(\d+)-", 1).cast("long") / 256))
    starts = running_in_bins(numbered, [], "bin", [F.col("file")], {"file_start": F.col("tokens")}).select("file", "file_start")
    schema = "file string, doc_id long, place long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                opened = TokenFile.of_bytes(content.as_py())
                docs, ends, ids = opened.doc_ids, opened.ends, opened.matrix.decode_all()
                begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(docs), pa.string()), pa.array(docs, pa.int64()), pa.array(begin), pa.array(ends - begin), pa.array(crcs, pa.int64())], names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lxwm").load(folder).select("path", "content")
    found = files.mapInArrow(run, schema)
    return found.join(starts, "file").select("doc_id", "file", (F.col("file_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """write_files and then read_documents: every column comes from the files that were read back."""
    folder = folder or new_folder(df.sparkSession, "wavelet")
    return read_documents(df.sparkSession, folder, write_files(df, folder, tokenizer_path, **options))


def _opened(folder: str, name: str):
    """A file of folder, of which only what is asked for is read."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    held = store.open_input_file(f"{root}/{name}")
    return held, TokenFile(lambda at, length: held.read_at(length, at))


def tokens_at(wanted: DataFrame, folder: str) -> DataFrame:
    """file, place, token: the ids at wanted places (file, place) of the files, by random access. A place outside its file is an
    error; repeated places have a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, places = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    held, opened = _opened(folder, names[a])
                    with held:
                        found = opened.matrix.access(places[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(found.astype(np.int64))], names=["file", "place", "token"])

    dealt = wanted.select(F.col("file").cast("string"), F.col("place").cast("long")).repartition("file", F.floor(F.col("place") / BLOCK_BITS)).sortWithinPartitions("file", "place")
    return dealt.mapInArrow(run, "file string, place long, token long")


def token_counts(manifest: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """file, token, n: how often each of the tokens stands in each file, by rank; no plane is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, opened = _opened(folder, name)
                with held:
                    counts = [opened.matrix.count(t, 0, opened.matrix.n) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(tokens), pa.string()), pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], names=["file", "token", "n"])

    return manifest.select("file").mapInArrow(run, "file string, token long, n long")


def token_occurrences(manifest: DataFrame, folder: str, token: int, batch_rows: int = 10_000) -> DataFrame:
    """file, doc_id, place (in the file), at (in the document) of every occurrence of a token, by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, opened = _opened(folder, name)
                with held:
                    lo, hi = opened.matrix._span(token, 0, opened.matrix.n)
                    for start in range(lo, hi, batch_rows):
                        places = np.array([opened.matrix._up(token, i) for i in range(start, min(hi, start + batch_rows))], np.int64)
                        doc = np.searchsorted(opened.ends, places, side="right")
                        begin = np.concatenate(([0], opened.ends))[doc]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array([opened.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(places), pa.array(places - begin)], names=["file", "doc_id", "place", "at"])

    return manifest.select("file").mapInArrow(run, "file string, doc_id long, place long, at long")
