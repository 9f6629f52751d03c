"""Token-ID files: tokenised documents in ascending id order, Simple-8b coded, written and read back.

An archive is a folder of part files in ascending order of doc_id. A part is a run of frames, and a frame
is little-endian:

    b"TS8G", u32 part, u32 frame of the part, u32 documents, u32 vocabulary, u64 ids, u32 blocks, u64 words,
    documents x (u8 has an id, i64 doc_id, u32 ids), vocabulary x u32, blocks x u32, words x u64, u32 crc32, "\\n"

The vocabulary lists the frame's distinct ids, most frequent first, and what Simple-8b packs are places in
it: frequent ids take few bits. Blocks end with documents, so that any document decodes alone from its
block offsets. Parts and frames are numbered in their heads, so that the order does not hang on names of files. The text writer puts frames in files (its line end is the frame's last byte), hence through
Spark's commit protocol and on any store that Spark can write to.

Nulls and edge cases: a null text is empty; a null doc_id sorts first and stays null; documents with equal
doc_id (or none) follow each other, the shorter ones first; an empty table gives no rows. Other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from tessera.functions.lineage import cut, discard, scratch
from tessera.llm import ragged, simple8b

END_ID = 1
FRAME_IDS = 1 << 19
FRAMES_PER_FILE = 32
CACHED_CHUNKS = 300_000
KEPT_CHUNKS = 100_000
JOINED = 256
ENCODED_BYTES = 4 << 20
_HEAD = struct.Struct("<4sIIIIQIQ")
_MAGIC = b"TS8G"

#: What the normaliser and the pre-tokeniser of a file must be for its texts to be encoded in chunks.
NORMALISER = ["NFC", (r"\s+", " "), "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

MARKS = ".,;:!?"
#: Letters and digits that stay letters and digits, one each, when they are composed and lower-cased.
PLAIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f"
_JOINED = re.compile(rf"[{MARKS}](?= )(?<=[^{PLAIN} ].)")
_CLOSING = re.compile(rf"(?<=[{PLAIN}])[{MARKS}](?= )")
_UNCERTAIN = re.compile("[\u0130\u03a3\u0530-\U0010ffff]")
SEPARATOR = "\x01"


def chunked(text: str) -> str:
    """The text as the chunks that are tokenised one by one, a blank after each: what stands between blanks and line feeds, without closing marks.

    Lower case is taken where the normaliser would make nothing else of it: each letter by itself, composed
    before and after. Marks before a blank are taken off where a plain letter, a digit or a blank stands before them;
    what else may stand there makes one piece with the mark, or does so once it is normalised.
    """
    text = text.replace("\n", " ")
    if "<|" not in text:  # the names of special tokens are written in lower case
        low = text.lower()
        if text.isascii():
            text = low
        elif not _UNCERTAIN.search(text) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
            text = low
    text += " "
    if _JOINED.search(text):
        text = _CLOSING.sub(r" \g<0>", text)
    else:
        for mark in MARKS:
            if mark in text:
                text = text.replace(f"{mark} ", f" {mark} ")
    return text


def in_chunks(file: dict) -> bool:
    """Whether a tokenizer file's texts may be encoded chunk by chunk, from what it says of itself."""
    normal = [(n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
    first, *others = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = first.get("type") == "Split" and first["pattern"].get("Regex") == PIECES and first["behavior"] == "Removed" and first["invert"]
    bytewise = [(k["type"], k["add_prefix_space"], k["use_regex"]) for k in others if k["type"] == "ByteLevel"] == [("ByteLevel", False, False)] and len(others) == 1
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(rf"[\s{MARKS}]|[^<].*<\|", t["content"])) and t["content"].startswith("<|") for t in file.get("added_tokens", []))
    return normal == NORMALISER and bool(split) and bytewise and added and not file.get("post_processor")


def byte_lengths(file: dict) -> np.ndarray | None:
    """Bytes of text that each id of a file stands for (``in_chunks``), if its model says so."""
    model = file["model"]
    if model.get("type") != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
        return None
    names = {i: len(token.removesuffix(model.get("end_of_word_suffix") or "")) for token, i in model["vocab"].items()}  # a letter of a token is a byte
    names |= {t["id"]: len(t["content"].encode()) for t in file.get("added_tokens", [])}
    out = np.zeros(max(names) + 1, np.int64)
    out[list(names)] = list(names.values())
    return out


def _normal(chunk: str) -> bool:
    """Whether the normaliser (composition, single blanks, lower case) surely leaves a chunk as it is."""
    if not chunk.isprintable() or chunk != chunk.lower():
        return False
    return chunk.isascii() or not _UNCERTAIN.search(chunk) and unicodedata.is_normalized("NFC", chunk)


class ChunkTokenizer:
    """A tokenizer of the tokenizers library behind a cache of chunks.

    Tokenizers that lower-case and keep no token across white space or between a letter or digit and the
    marks ``.,;:!?``, as their files say (``in_chunks``), encode each distinct chunk once for as long as the cache
    holds it. With any other file whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.whole = not in_chunks(file)
        self.bytes = None if self.whole else byte_lengths(file)
        # for what the normaliser leaves as it is: the same tokenizer without one
        self.normaliser, self.bare = self.library.normalizer, normalizers.Sequence([])
        alone = [] if self.whole else self.library.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = alone[0] if len(alone) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.hits = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def release(self) -> None:
        """Forget what will hardly be asked for again: a worker that is done with a task may serve other operators for long."""
        self.prune(KEPT_CHUNKS)
        ragged.give_back()

    def prune(self, most: int) -> None:
        """Keep what was asked for twice or more since the last time; most chunks of a corpus never come again."""
        often = np.flatnonzero(self.hits[: len(self.known)] > 1)
        if len(often) > most:
            often = often[np.argsort(-self.hits[often], kind="stable")[:most]]
        chunks, ids, size = list(self.known), self._gather(often), self.size[often].astype(np.int64)
        self.clear()
        self._add([chunks[k] for k in often.tolist()], size, ids)

    def _add(self, chunks: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        """New chunks with the numbers of their ids, and all these ids."""
        k = len(self.known)
        while k + len(chunks) > len(self.size):
            self.start, self.size, self.hits = (np.concatenate((a, np.zeros_like(a))) for a in (self.start, self.size, self.hits))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k : k + len(chunks)] = size
        self.start[k : k + len(chunks)] = self.used + np.cumsum(size) - size
        self.known.update(zip(chunks, range(k, k + len(chunks)), strict=True))
        self.used += len(ids)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the known chunks ``at``, one after the other."""
        size = self.size[at].astype(np.int64)
        shift = np.repeat(self.start[at] - (np.cumsum(size) - size), size)
        return self.ids[np.arange(len(shift)) + shift]

    def _split(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of ids and ids of chunks that the normaliser leaves as they are; None if the bytes of the ids do not add up to those of the chunks."""
        joined = [" ".join([*chunks[k : k + JOINED], ""]) for k in range(0, len(chunks), JOINED)]
        self.library.normalizer = self.bare
        found = self.library.encode_batch_fast(joined, add_special_tokens=False)
        self.library.normalizer = self.normaliser
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(one.ids, np.uint32) for one in found)])
        blanks = np.flatnonzero(np.frombuffer("".join(joined).encode(), np.uint8) == 0x20)
        ends = blanks - np.arange(len(blanks))
        reached = np.concatenate(([0], np.cumsum(self.bytes[ids])))
        upto = np.searchsorted(reached, ends, side="right") - 1
        if not len(ends) == len(chunks) or not np.array_equal(reached[upto], ends) or upto.max(initial=0) != len(ids):
            return None
        return np.diff(upto, prepend=0), ids

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks many at once: told apart by their bytes, or else joined by a separator whose single id no other chunk has."""
        groups: dict[str, list[str]] = {"clean": [], "plain": [], "odd": []}
        for c in chunks:
            groups["clean" if self.bytes is not None and _normal(c) else "odd" if self.separator is None or SEPARATOR in c else "plain"].append(c)
        if found := groups["clean"] and self._split(groups["clean"]):
            self._add(groups["clean"], *found)
        else:
            groups["odd" if self.separator is None else "plain"] += groups["clean"]
        own = groups["plain"]
        found = self.library.encode_batch_fast([f" {SEPARATOR} ".join(own[k : k + JOINED]) for k in range(0, len(own), JOINED)], add_special_tokens=False)
        ids = [np.append(np.array(one.ids, np.uint32), np.uint32(self.separator)) for one in found]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.flatnonzero(flat == self.separator)
        self._add(own, np.diff(ends, prepend=-1) - 1, flat[flat != self.separator])
        found = [one.ids for one in self.library.encode_batch_fast(groups["odd"], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._add(groups["odd"], size, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the number of each."""
        if self.whole:
            found = [[*one.ids, end_id] for one in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n
        split = [f"{chunked(t)} " for t in texts]  # the last chunk, an empty one, has the place of the end id
        raw = "".join(split).encode()
        offsets = np.concatenate(([0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20) + 1))
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        names, _ = ragged.buffer_of(coded.dictionary)
        distinct = names.tobytes().decode().split(" ")[:-1]
        which = coded.indices.to_numpy()
        if len(self.known) > CACHED_CHUNKS:
            self.prune(CACHED_CHUNKS // 2)
        own = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(own < 0)):
            missed = [distinct[k] for k in new.tolist()]
            self._learn(missed)
            own[new] = np.fromiter(map(self.known.__getitem__, missed), np.int64, len(missed))
        self.hits[own] += np.bincount(which, minlength=len(own)).astype(np.int32)
        end = f" {end_id}"  # what no chunk is: they have no blanks
        if end not in self.known:
            self._add([end], np.ones(1, np.int64), np.array([end_id], np.uint32))
        at = own[which]
        last = np.cumsum([t.count(" ") for t in split], dtype=np.int64) - 1
        at[last] = self.known[end]
        n = np.add.reduceat(self.size[at].astype(np.int64), np.concatenate(([0], last[:-1] + 1))) if texts else np.zeros(0, np.int64)
        return self._gather(at), n


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def tokenised(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (u16 if all of a run of documents fit, else u32, little-endian)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tokenizer(path)
        try:
            yield from encoded(held, batches)
        finally:
            held.release()

    def encoded(held: ChunkTokenizer, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text", ENCODED_BYTES):
                ids, n = held.encode([t or "" for t in part.column("text").to_pylist()], end_id)
                w = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
                raw, ends = pa.py_buffer(ids.astype(f"<u{w}")), np.concatenate(([0], np.cumsum(n) * w)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), raw])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), packed], ["doc_id", "n_tokens", "ids"])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def frame(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, part: int = 0, number: int = 0) -> bytes:
    """One frame, the given one of its part, without the line end that closes it."""
    counts = np.asarray(counts, np.int64)
    if len(ids) and int(ids.max()) < 1 << 20:
        often, place = np.bincount(ids), ids
        order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
        vocabulary, rank = order, np.zeros(len(often), np.int64)
    else:
        names, place, often = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        vocabulary, rank = names[order], np.zeros(len(order), np.int64)
    rank[order] = np.arange(len(order))
    per_doc = -(-counts // simple8b.BLOCK)
    lengths = np.full(int(per_doc.sum()), simple8b.BLOCK, np.int64)
    last = np.cumsum(per_doc)[per_doc > 0] - 1
    lengths[last] = (counts - (per_doc - 1) * simple8b.BLOCK)[per_doc > 0]
    words, offsets = simple8b.encode(rank[place], lengths)
    table = np.zeros(len(counts), np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<u4")]))
    table["known"], table["id"], table["n"] = [d is not None for d in doc_ids], [d or 0 for d in doc_ids], counts
    body = _HEAD.pack(_MAGIC, part, number, len(counts), len(vocabulary), len(ids), len(lengths), len(words)) + table.tobytes() + vocabulary.astype("<u4").tobytes() + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def frames(content: bytes) -> Iterator[tuple[tuple[int, int], list[int | None], np.ndarray, np.ndarray]]:
    """Part and frame number, doc_ids, their numbers of ids, and all ids, of each frame of a part file."""
    at = 0
    while at < len(content):
        magic, part, number, docs, vocabulary, n_ids, blocks, n_words = _HEAD.unpack_from(content, at)
        size = _HEAD.size + 13 * docs + 4 * vocabulary + 4 * blocks + 8 * n_words
        if magic != _MAGIC or at + size + 5 > len(content) or zlib.crc32(content[at : at + size]) != struct.unpack_from("<I", content, at + size)[0]:
            raise ValueError(f"no intact frame at byte {at}")
        pos = at + _HEAD.size
        table = np.frombuffer(content, np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<u4")]), docs, pos)
        words_at = pos + 13 * docs + 4 * vocabulary + 4 * blocks
        names = np.frombuffer(content, "<u4", vocabulary, pos + 13 * docs)
        offsets = np.frombuffer(content, "<u4", blocks, pos + 13 * docs + 4 * vocabulary).astype(np.int64)
        counts = table["n"].astype(np.int64)
        per_doc = -(-counts // simple8b.BLOCK)
        lengths = np.full(blocks, simple8b.BLOCK, np.int64)
        lengths[np.cumsum(per_doc)[per_doc > 0] - 1] = (counts - (per_doc - 1) * simple8b.BLOCK)[per_doc > 0]
        places = simple8b.decode(np.frombuffer(content, "<u8", n_words, words_at).astype(np.uint64), offsets, lengths)
        yield (part, number), [i if k else None for k, i in zip(table["known"].tolist(), table["id"].tolist(), strict=True)], counts, names[places.astype(np.int64)]
        at += size + 5


def write_ranges(tokens: DataFrame, path: str, bounds: list[int]) -> None:
    """Part k holds the ids from bounds[k - 1] on and below bounds[k]."""
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    part = F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))), F.lit(0))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            arrays = [np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4") for _, n, raw, _ in held]  # n is 1 at least
            made = frame([r[0] for r in held], [r[1] for r in held], np.concatenate(arrays), held[0][3], number)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["frame"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "part")), strict=True):
                held.append(row)
                size += row[1]
                if size >= FRAME_IDS:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()
        ragged.give_back()

    dealt = tokens.withColumn("part", part.cast("int")).repartitionById(len(bounds) + 1, "part")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    coded = ordered.select("doc_id", "n_tokens", "ids", "part").mapInArrow(run, "frame binary")
    coded.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)


def read(spark, path: str) -> DataFrame:
    """part, frame (of the part), doc_id, before (ids before it in the frame), n_tokens, ids_crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for (part, number), doc_ids, n, ids in frames(content.as_py()):
                    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n)
                    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
                    columns = [pa.array([part] * len(n), pa.int32()), pa.array([number] * len(n), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "frame", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "part int, frame long, doc_id long, before long, n_tokens long, ids_crc32 long")


def offsets(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before. What is summed up is one row a frame within a part, and one row a part over all."""
    totals = rows.groupBy("part", "frame").agg(F.sum("n_tokens").alias("total"))
    before = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("total").alias("whole")).select("part", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("earlier"))
    ahead = totals.select("part", "frame", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead")).join(parts, "part")
    return rows.join(ahead, ["part", "frame"]).withColumn("start", F.col("earlier") + F.col("ahead") + F.col("before"))


def round_trip(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, keep: str | None = None) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    keep: the folder of the archive; without one it is scratch space and goes once it has been read.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bounds from the id column alone, so that the texts are tokenised once
    probs = [k / parts for k in range(1, parts)]
    found = documents.agg(F.percentile_approx(F.col(id_column).cast("long"), probs, 10_000).alias("b")).first()["b"] if probs else None
    where = keep or scratch(spark, "tokens")
    write_ranges(tokenised(documents, path, id_column, text_column, end_id), where, sorted(set(found or [])))
    rows = cut(read(spark, where))
    if not keep:
        discard(spark, where)
    return offsets(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
