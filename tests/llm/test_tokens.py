import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import simple8b, token_counts, token_files
from tessera.llm.queries import COUNTED, ENCODED, vocabulary

ODD = ["", "aaaaaaaaaaaaaaaa", "a<|endoftext|>b <|endoftext|>", "<|startoftext|> x<|ENDOFTEXT|>", "　   x", "\x1c\x1d a\x85b", "É H̱ ΑΣ ΣΑΣ. İ", "a\t\tb\x0b\r\nc", "１２３ 你好 \U0001f389\U0001f389  it's they'll", "x" * 3000, "ab" * 500 + "\n\n\n  ", "end. mid.dle !!. ?? _. a,b , \x01 x\x01y 'S don'T. <|. |>, K. É, ÀÉ!"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@pytest.fixture(scope="module")
def merges():
    return token_counts.MergeTable(vocabulary(COUNTED))


@pytest.fixture(scope="module")
def chunks():
    return token_files.ChunkTokenizer(vocabulary(ENCODED))


def test_counts_are_the_library_s(merges, docs):
    texts = ODD + [r.text for r in docs.collect()]
    assert merges.count_texts(texts) == [len(e.ids) for e in library(COUNTED).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(text):
    merges = token_counts._TABLES.setdefault("test", token_counts.MergeTable(vocabulary(COUNTED)) if "test" not in token_counts._TABLES else token_counts._TABLES["test"])
    global _COUNTED
    _COUNTED = globals().get("_COUNTED") or library(COUNTED)
    assert merges.count_texts([text])[0] == len(_COUNTED.encode(text, add_special_tokens=False).ids)


def test_ids_are_the_library_s(chunks, docs):
    texts = ODD + [r.text for r in docs.collect()]
    ids, n = chunks.encode(texts, 1)
    want = [e.ids + [1] for e in library(ENCODED).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA bB.,!?;:'_-<|>\ṉ́ΣİéÉ\x01")), max_size=40))
def test_ids_of_any_text(text):
    global _IDS, _CHUNKS
    _IDS, _CHUNKS = globals().get("_IDS") or library(ENCODED), globals().get("_CHUNKS") or token_files.ChunkTokenizer(vocabulary(ENCODED))
    assert _CHUNKS.encode([text], 1)[0].tolist() == _IDS.encode(text, add_special_tokens=False).ids + [1]


def test_letters_that_are_more_than_one_once_normalised(chunks):
    """Every code point that lower case or composition changes, and a sample of the others, before and after each mark."""
    import unicodedata

    changed = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (len(chr(c).lower()) > 1 or unicodedata.normalize("NFC", chr(c)) != chr(c))]
    others = [chr(c) for c in [*range(0x20, 0x600), *range(0x600, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"A{c}{m} {c}{m} {m}{c} b" for c in some[k : k + 40]) for some in (changed, others) for m in token_files.MARKS for k in range(0, len(some), 40)]
    texts += ["DİYARBAKIRLİ. b", "İ, x", "BİNGÖLİ!", "Été, ÉTÉ. Σ. ΑΣ, x", "a.. b,. c?! (d). e\u0301. f", ". a , b", "x. "]
    ids, n = chunks.encode(texts, 1)
    want = [e.ids + [1] for e in library(ENCODED).encode_batch(texts, add_special_tokens=False)]
    assert len(changed) > 1000 and n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_files_get_whole_texts(docs):
    from tokenizers import Tokenizer

    texts = ODD + [r.text for r in docs.limit(20).collect() if r.text]
    other = token_files.ChunkTokenizer(vocabulary(COUNTED))
    assert other.whole and not token_files.ChunkTokenizer(vocabulary(ENCODED)).whole
    tool = Tokenizer.from_file(vocabulary(COUNTED))
    assert other.encode(texts, 1)[0].tolist() == [i for t in texts for i in [*tool.encode(t, add_special_tokens=False).ids, 1]]


def test_a_released_cache_changes_nothing(chunks, docs):
    texts = [r.text for r in docs.limit(60).collect() if r.text]
    want = chunks.encode(texts, 1)[0].tolist()
    chunks.release()
    assert chunks.encode(texts, 1)[0].tolist() == want


def test_starts_beyond_a_thousand_files(docs, monkeypatch, spark):
    """One small frame a file, so that names of files do not sort as their numbers do."""
    monkeypatch.setattr(token_files, "FRAME_IDS", 1)
    monkeypatch.setattr(token_files, "FRAMES_PER_FILE", 1)
    frame = spark.range(2300).selectExpr("id AS doc_id", "concat('word ', id) AS text").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = token_files.round_trip(frame, vocabulary(ENCODED))
        assert sorted(map(tuple, found.collect())) == sorted(want_rows(frame))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_full_caches_change_nothing(chunks, monkeypatch, docs):
    texts = [r.text for r in docs.limit(40).collect()]
    want = chunks.encode(texts, 1)[0].tolist()
    monkeypatch.setattr(token_files, "CACHED_CHUNKS", 50)
    assert [i for t in texts for i in chunks.encode([t], 1)[0].tolist()] == want


def test_a_chunk_is_looked_up_once_a_call(chunks, monkeypatch):
    """The cost of op5: what occurs often is found by its place among the distinct chunks, not by a lookup each time."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    texts = ["the cat sat, on 7 mats. " * 500, "the dog sat. " * 500]
    want = chunks.encode(texts, 1)[0].tolist()
    monkeypatch.setattr(chunks, "known", Counted(chunks.known))
    assert chunks.encode(texts, 1)[0].tolist() == want == [i for t in texts for i in [*library(ENCODED).encode(t, add_special_tokens=False).ids, 1]]
    assert 0 < Counted.asked <= 20


def test_chunks_whose_bytes_do_not_add_up(docs, monkeypatch):
    """Ends of words inside texts, and lengths of ids that are none: the separator tells chunks apart then."""
    texts = ["a</w> b</w>c </w> </w>", "the  cat 1,5</w>.", "", *ODD, *(r.text for r in docs.limit(10).collect() if r.text)]
    want = [i for t in texts for i in [*library(ENCODED).encode(t, add_special_tokens=False).ids, 1]]
    own = token_files.ChunkTokenizer(vocabulary(ENCODED))
    assert own._split(["the", "", "cat7", "é!"]) is not None and own.encode(texts, 1)[0].tolist() == want
    for wrong in (own.bytes * 0, own.bytes + 1, None):
        own.clear()
        monkeypatch.setattr(own, "bytes", wrong)
        assert own.encode(texts, 1)[0].tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=256), max_size=6))
def test_simple8b(blocks):
    values = np.array([v for b in blocks for v in b], np.uint64)
    lengths = np.array([len(b) for b in blocks], np.int64)
    words, offsets = simple8b.encode(values, lengths)
    assert simple8b.decode(words, offsets, lengths).tolist() == values.tolist()
    for k, b in enumerate(blocks):  # each block decodes alone
        end = offsets[k + 1] if k + 1 < len(blocks) else len(words)
        assert simple8b.decode(words[offsets[k] : end], np.zeros(1, np.int64), lengths[k : k + 1]).tolist() == b


def test_frames_round_trip_and_show_damage():
    ids, n = np.array([5, 7, 70_000, 1, 1, 1], np.uint32), np.array([4, 0, 2])
    data = token_files.frame([3, None, 9], n, ids, 7, 1200) + b"\n"
    (at, doc_ids, counts, back), other = token_files.frames(data + data)
    assert at == (7, 1200) and doc_ids == [3, None, 9] and counts.tolist() == [4, 0, 2] and back.tolist() == ids.tolist() and other[3].tolist() == ids.tolist()
    with pytest.raises(ValueError):
        list(token_files.frames(data[:30] + bytes([data[30] ^ 1]) + data[31:]))


def want_rows(frame):
    tool, out, start = library(ENCODED), [], 0
    rows = [(r.doc_id, tool.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in frame.collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for d, ids in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), np.array(x[1], "<u2").tobytes())):
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(docs, odd, none, tmp_path, spark):
    for frame in (docs, odd):
        found = token_files.round_trip(frame, vocabulary(ENCODED))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want_rows(frame), key=repr)
    assert token_files.round_trip(none, vocabulary(ENCODED)).count() == 0
    kept = f"file://{tmp_path}/tokens"
    token_files.round_trip(docs, vocabulary(ENCODED), keep=kept)
    again = token_files.offsets(token_files.read(spark, kept)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, again.collect())) == sorted(want_rows(docs))


def test_count_query(odd, none):
    tool = library(COUNTED)
    rows = token_counts.count_tokens(odd, vocabulary(COUNTED)).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(tool.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in odd.collect()]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(none, vocabulary(COUNTED)).count() == 0


def test_files_of_other_kinds_are_refused(tmp_path):
    import json

    with open(vocabulary(COUNTED), encoding="utf-8") as f:
        file = json.load(f)
    first = file["model"]["merges"][0]
    for change in ({"pre_tokenizer": file["pre_tokenizer"] | {"use_regex": False}}, {"model": file["model"] | {"merges": [*file["model"]["merges"], first]}}, {"normalizer": {"type": "Lowercase"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            token_counts.MergeTable(str(path))
