"""Packing by shortest-pack-first over the length histogram.

Each document is tokenised once and cut into full sequences and a rest; the
histogram of piece lengths has at most ``length`` entries, whatever the
corpus. Lengths are placed longest first, each into the packs with the most
room, by updating counts of packing patterns (Krell et al., 2021). A pattern's
slots are then joined back to the pieces by their rank among equal lengths.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.ranks import gapless_rank
from partloom.llm.runtime import materialise, worker_store


@dataclass(frozen=True)
class Packing:
    """tokenizer: file of a public tokenizer, the same path on driver and executors. end: id put after each document.

    fast: encode by the faster BPE where ``agreed`` finds it equal; without, the tokenizer itself encodes every text.
    """

    tokenizer: str
    length: int = 2048
    end: int = 1
    fast: bool = True


#: Characters whose classes ``agreed`` compares one by one.
COMPARED = [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x1FB00)]
#: What the faster BPE isn't given: other characters, and runs so long that its splitting would be slow.
UNUSUAL = re.compile("[^\x01-\uffff\U0001f000-\U0001faff]|\\S{1000}|\\s{200}")


#: Fixed value: how byte-level BPE cuts texts before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def fast_twin(path: str):
    """The same vocabulary in a faster BPE, or None where the file isn't a byte-level BPE whose ids are its merge ranks."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file.get("model", {}), {x["content"] for x in file.get("added_tokens", [])}
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    level = file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or file.get("normalizer") or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True):
        return None
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("twin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian 32-bit strings.

    Where ``fast``, a faster BPE with the tokenizer's own vocabulary encodes
    texts; those that hold a special token's string or are ``UNUSUAL`` go to
    the tokenizer itself. Nothing is remembered from text to text.
    """

    def __init__(self, path: str, fast: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.twin = fast_twin(path) if fast else None
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]  # read as tokens

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def usual(self, text: str) -> bool:
        return not any(x in text for x in self.special) and not UNUSUAL.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if text and self.twin and self.usual(text):
                out[i] = self.twin.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            elif text:
                rest.append(i)
        if rest:
            for i, found in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
                out[i] = found
        return out


def agreed(path: str, encoder: Encoder | None = None) -> bool:
    """Whether the faster BPE gives the tokenizer's ids: for every text of its vocabulary, and for every character
    of ``COMPARED`` inside words, inside numbers, and after spaces and line feeds."""
    e = encoder or Encoder(path, True)
    if e.twin is None:
        return False
    texts = [t for t in (e.tokenizer.decode([i]) for i in range(e.tokenizer.get_vocab_size())) if t and "\ufffd" not in t]
    for at in range(0, len(COMPARED), 512):
        texts.append("".join(f"a{c}b 1{c}2 {c}.\n{c}  {c}'s" for c in map(chr, COMPARED[at : at + 512])))
    texts = [t for t in texts if not any(x in t for x in e.special)]
    fast = lambda t: e.twin.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes()
    return all([fast(t) for t in texts[at : at + 16]] == e.whole(texts[at : at + 16]) for at in range(0, len(texts), 16))


def _encoder(path: str, fast: bool) -> Encoder:
    """The worker's encoder."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_store(f"encoder {path} {fast}", lambda: Encoder(path, fast), large=True)


@functools.cache
def agreed_in_a_task(application: str, path: str) -> bool:
    """``agreed``, found once for an application by a task, so that the driver holds no tokenizer."""
    from pyspark.sql import SparkSession

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([agreed(path, _encoder(path, True))])], names=["agreed"])

    return SparkSession.getActiveSession().range(0, 1, 1, 1).mapInArrow(run, "agreed boolean").first()["agreed"]


def _pieces(p: Packing, fast: bool):
    def run(batches):
        encoder = _encoder(p.tokenizer, fast)
        end, width = np.array([p.end], dtype="<u4").tobytes(), 4 * p.length
        for batch in batches:
            rows, group, held = [], [], 0
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()

            def flush(rows=rows, group=group, texts=texts, ids=ids):
                for i, found in zip(group, encoder.encode([texts[i] or "" for i in group]), strict=True):
                    data = found + end
                    for at in range(0, len(data), width):
                        part = data[at : at + width]
                        rows.append((ids[i], at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4))
                group.clear()

            for i, text in enumerate(texts):
                group.append(i)
                held += len(text or "")
                if held > 1 << 20:
                    flush()
                    held = 0
            flush()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that use every length as often as the histogram says.

    ``room`` keeps, for each free space, the patterns that have it. A length
    goes to the packs with the most room; what doesn't fit anywhere opens packs.
    """
    room: dict[int, list[list]] = {}
    done = []
    for size in range(length, 0, -1):
        left = histogram.get(size, 0)
        while left:
            most = max(room, default=0)
            if most < size:
                room.setdefault(length - size, []).append([left, (size,)])
                break
            count, pattern = room[most].pop()
            if not room[most]:
                del room[most]
            used = min(count, left)
            if used < count:
                room.setdefault(most, []).append([count - used, pattern])
            room.setdefault(most - size, []).append([used, (*pattern, size)])
            left -= used
        done += room.pop(0, [])
    for patterns in room.values():
        done += patterns
    return [(c, p) for c, p in done]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each slot of each pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for size in lengths:
            first = used.get(size, 0)
            used[size] = first + count
            out.append((size, first, count, sequence, offset))
            offset += size
        sequence += count
    return out


def token_pieces(docs: DataFrame, params: Packing) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens: each document cut every ``length`` ids."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fast = params.fast and agreed_in_a_task(docs.sparkSession.sparkContext.applicationId, params.tokenizer)
    return slim.mapInArrow(_pieces(params, fast), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, params: Packing) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One row per piece; every id of every document lies in exactly one. A null
    or empty text is a document of the end id alone. Repeated rows and rows
    without a doc_id are packed one by one, and texts of any length are cut
    into pieces. Sequences are numbered without gaps. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, params), "pieces")
    histogram = dict(pieces.groupBy("length").count().collect())  # at most params.length rows
    slots = _slots(shortest_pack_first(histogram, params.length))
    names = "its_length long, first long, ranks long, first_sequence long, offset long"
    slots = F.broadcast(spark.createDataFrame(slots, names))  # a few slots for each of at most params.length lengths
    ranked = gapless_rank(pieces, "length", ["doc_id", "start", "ids_crc32"], "rank")
    fits = (F.col("length") == F.col("its_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    return ranked.join(slots, fits).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
