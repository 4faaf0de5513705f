"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences.

Leaves are sentences, their digests make the digest of a paragraph (a line), paragraphs make sections, sections make the root.
A section ends at a blank line, before a heading, or where the digest of a paragraph says so, so an edit moves the bounds of its
own section only. Equal roots mean equal texts; where roots differ, the differing branches lead to the edits.
"""

from __future__ import annotations

import re
import zlib
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import id_ranges, map_texts, quoted

LEAF = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
#: A leaf longer than this is cut behind words chosen by their checksum, and after so many words anyway.
LONG_LEAF, LONG_WORDS = 100, 16
#: Paragraphs of a section on average, where the text has no marks of its own.
FAN_OUT = 8


def _leaves(paragraph: str) -> list[str]:
    out = []
    for leaf in LEAF.findall(paragraph):
        if len(leaf) <= LONG_LEAF:
            out.append(leaf)
            continue
        words, at = re.findall(r"\s*\S+\s*", leaf) or [leaf], 0
        for i, w in enumerate(words):
            if i + 1 - at == LONG_WORDS or i + 1 == len(words) or zlib.crc32(w.encode()) % 8 == 0:
                out.append("".join(words[at : i + 1]))
                at = i + 1
    return out


def _digest(parts: list[bytes], level: bytes) -> bytes:
    return blake2b(b"".join(parts), digest_size=16, person=level).digest()


def fingerprint(text: str) -> str:
    """`root/section/section...`, where a section is `tag:paragraph,paragraph...` and a paragraph four characters a sentence.

    The root is 32 hexadecimal digits over the full digests below it."""
    sections: list[tuple[bytes, list[str]]] = []
    digests: list[bytes] = []
    told: list[str] = []

    def close() -> None:
        nonlocal digests, told
        if digests:
            sections.append((_digest(digests, b"section"), told))
            digests, told = [], []

    for paragraph in text.split("\n") if text else []:
        if paragraph.startswith("#"):
            close()
        leaves = [blake2b(x.encode(), digest_size=16).digest() for x in _leaves(paragraph)]
        digests.append(_digest(leaves, b"paragraph"))
        told.append(b64encode(b"".join([x[:3] for x in leaves])).decode())
        if not paragraph.strip() or digests[-1][0] % FAN_OUT == 0:
            close()
    close()
    root = _digest([d for d, _ in sections], b"root").hex()
    return "/".join([root, *(f"{b64encode(d[:3]).decode()}:{','.join(t)}".replace("/", "_") for d, t in sections)])


def _parsed(print_: str) -> list[tuple[str, list[str]]]:
    return [(s[:4], s[5:].split(",")) for s in print_.split("/")[1:]]


def _sentences(print_: str) -> Counter:
    out: Counter = Counter()
    for _, paragraphs in _parsed(print_):
        for p in paragraphs:
            out.update([p[i : i + 4] for i in range(0, len(p), 4)])
    return out


def likeness(a: str, b: str) -> float:
    """From 0 to 1: twice the sentences that both trees hold over all their sentences; 1 for equal roots. A fingerprint tells a
    sentence by 24 bits, so two unlike ones count as alike with a probability of 6e-8 a pair; roots have 128 bits."""
    return _likeness(a, b, _sentences(a), _sentences(b))


def _likeness(a: str, b: str, in_a: Counter, in_b: Counter) -> float:
    if a[:32] == b[:32]:
        return 1.0
    small, large = (in_a, in_b) if len(in_a) < len(in_b) else (in_b, in_a)
    both = sum(min(n, large[x]) for x, n in small.items() if x in large)
    total = in_a.total() + in_b.total()
    # texts whose roots differ are never wholly alike, though they may hold the same sentences in another order
    return min(2 * both / total, 1 - 1 / (total + 1)) if total else 0.0


def locate_edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, sentence) of b that a does not have at the same branch, found by descending into differing branches;
    paragraphs and sections are matched by their tags, so what only moved down is not an edit."""
    if a[:32] == b[:32]:
        return []
    old, out = _parsed(a), []
    sections = Counter((tag, tuple(p)) for tag, p in old)
    paragraphs = Counter(p for _, ps in old for p in ps)
    sentences = _sentences(a)
    for i, (tag, ps) in enumerate(_parsed(b)):
        if sections[tag, tuple(ps)]:
            sections[tag, tuple(ps)] -= 1
            continue
        for j, p in enumerate(ps):
            if paragraphs[p]:
                paragraphs[p] -= 1
                continue
            for k in range(0, len(p), 4):
                if sentences[p[k : k + 4]]:
                    sentences[p[k : k + 4]] -= 1
                else:
                    out.append((i, j, k // 4))
    return out


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `fingerprint` to df. A null text counts as the empty one, whose tree has no section; equal texts have equal
    fingerprints, repeated rows and an empty df pass through, and a column of that name is replaced."""

    def work():
        return lambda texts: [pa.array([fingerprint(t) for t in texts.to_pylist()], pa.string())]

    return map_texts(df, text_col, "fingerprint string", work, keep)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the beginning of following, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITS = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_study(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edit of it with the next one's beginning, next by descending id_col, the first after the last:
    doc_id, n_chars (code points), edited (the text), fingerprint, edited_fingerprint, near_edited, near_next (likeness of the
    fingerprint to the edited text's and to the next document's).

    The texts move once, dealt by (id, text hash) ranges of equal row counts; the first document of each range is sent to the
    range before as well, so every task sees its last document's successor. Null ids come last; equal ids and null ids, which
    may fill several ranges, are ordered by the hash of their text; null texts are empty; a lone document is its own successor.
    Other columns are not used; an empty df gives an empty result."""
    rows = df.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ranges = id_ranges(rows, "id")
    of = ranges.of(F.col("id"), F.col("hash")).cast("int")
    first = F.max(F.struct("id", "hash"))  # null is the least, as it comes last
    firsts = {r["b"]: tuple(r["first"]) for r in rows.groupBy(of.alias("b")).agg(first.alias("first")).collect()}  # a row for each range
    held = sorted(firsts)
    goes_to = [(*firsts[b], held[(i + 1) % len(held)]) for i, b in enumerate(held)]  # first of a range: the range that precedes it
    if goes_to:
        first_of = df.sparkSession.createDataFrame(goes_to, "first long, first_hash long, extra int")
        # a row for each range, of which there are about as many as partitions
        rows = rows.join(F.broadcast(first_of), F.col("id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("first_hash")), "left")
    extra = F.col("extra") if goes_to else F.lit(None).cast("int")
    own = F.struct(of.alias("bin"), F.lit(0).alias("guest"))
    sent = F.when(extra.isNull(), F.array(own)).otherwise(F.array(own, F.struct(extra.alias("bin"), F.lit(1).alias("guest"))))
    dealt = rows.select("id", "text", "hash", F.inline(sent)).repartitionById(ranges.count, "bin").sortWithinPartitions("bin", "guest", F.desc_nulls_last("id"), F.desc("hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # id, text, fingerprint, sentences
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for i, text, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(4).to_pylist(), strict=True):
                if guest and held is None:
                    continue  # further rows of the same id
                text = text.as_py()
                of_text = fingerprint(text)
                inside = _sentences(of_text)
                if held is not None:
                    before_id, before, of_before, in_before = held
                    new = edited(before, text)
                    of_new = fingerprint(new)
                    out.append((before_id, len(before), new, of_before, of_new, _likeness(of_before, of_new, in_before, _sentences(of_new)), _likeness(of_before, of_text, in_before, inside)))
                    size += len(new)
                held = None if guest else (i, text, of_text, inside)
                if size >= 4 << 20:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return dealt.mapInArrow(run, EDITS)
