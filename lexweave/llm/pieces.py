"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model holds a whitespace marker behind another character, segmentation cannot cross the start of a run of
markers. A text is therefore cut before each such run, each distinct marked word of a slice is segmented once, and the ids are
joined back by position. A model with crossing pieces is detected from its vocabulary and gets whole texts instead.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexweave.llm._common import chunk_array, joined_back, map_texts, text_buffers

MARK = "▁"


def crossing(processor) -> bool:
    """Whether a piece of the model, or its way of handling white space, makes chunks depend on their neighbours."""
    if any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(processor.vocab_size())):
        return True
    # the chunks rely on these: a marker before the text, white space kept as it is, any other character left alone
    probe = "  a \t  ﬁÅÅ b\n c  "
    return processor.normalize(probe) != MARK + probe.replace(" ", MARK)


class ChunkEncoder:
    """Texts to ids without begin and end; whole_texts forces the plain path of the library."""

    def __init__(self, model_path: str, whole_texts: bool = False):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.whole = whole_texts or crossing(self.model)
        self.lone = [self.model.piece_to_id(MARK)]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and where each text begins (with the end)."""
        if self.whole:
            return joined_back(self.model.encode(texts.to_pylist(), num_threads=1), np.arange(len(texts)))
        empty = np.diff(text_buffers(texts)[1]) == 0
        # the library turns a space into a marker and leaves a literal one, so both are one thing here
        marked = pc.binary_join_element_wise(pa.scalar(" "), pc.replace_substring(texts, MARK, " "), pa.scalar(""))
        data, rows = text_buffers(marked)
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[rows[:-1]] = True
        starts = np.flatnonzero(begins)
        table = chunk_array(data, starts).dictionary_encode()
        words = pc.utf8_slice_codeunits(table.dictionary, 1).to_pylist()
        ids = [x or self.lone for x in self.model.encode(words, num_threads=1)]
        index = table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.searchsorted(starts, rows)
        ids.append([])
        index[first[:-1][empty]] = len(ids) - 1
        flat, ends = joined_back(ids, index)
        return flat, ends[first]


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, begin_end: bool = True, decode: bool = True, whole_texts: bool = False) -> DataFrame:
    """Adds `ids` (binary: all ids of the whole text, little-endian unsigned 32-bit) and `decoded` (the library's decode of
    them; null without decode) to df. Columns of these names are replaced; the other columns of df, or those of keep, go along.

    Null and empty texts give only the begin and end ids and decode to the empty text. Repeated rows stay repeated, and an
    empty df gives an empty result. A text of any length is encoded whole."""
    made = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def work():
        encoder = ChunkEncoder(model_path, whole_texts)
        head, tail = ([encoder.model.bos_id()], [encoder.model.eos_id()]) if begin_end else ([], [])
        head_b, tail_b = (np.array(x, "<u4").tobytes() for x in (head, tail))

        def each(texts: pa.StringArray) -> list[pa.Array]:
            flat, ends = encoder(texts)
            raw, listed = flat.astype("<u4").tobytes(), flat.tolist()
            bounds = ends.tolist()
            spans = list(zip(bounds, bounds[1:], strict=False))
            ids = pa.array([head_b + raw[4 * a : 4 * b] + tail_b for a, b in spans], pa.binary())
            told = encoder.model.decode([head + listed[a:b] + tail for a, b in spans], num_threads=1) if decode and spans else [None] * len(spans)
            return [ids, pa.array(told, pa.string())]

        return each

    # the library takes ids as lists, which are large
    return map_texts(df, text_col, made, work, keep, 2 << 20)
