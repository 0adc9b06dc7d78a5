"""Tokens, media, decontamination, quality and language against plain counterparts."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from backtrail.llm import bpe, decontam, language_id, media_mpeg, quality_fm, queries, wordpiece
from tests.llm.conftest import EDGES, LONG
from tests.oracle import DATA


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe_path())


def test_bpe_equals_the_library(library):
    own = bpe.ForcedBoundaryBpe(queries.word_bpe_path())
    texts = pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()[:60] + [r[1] or "" for r in EDGES["documents"]]
    random.seed(4)
    odd = "aé éİß'stred <|startoftext|>\x1c\x85\u00a0\u3000\u200b中文12!?#😀ΑΣİΣ'S\n\t\x00가ǅKﬁ\u0301"
    texts += ["".join(random.choice(odd) for _ in range(random.randrange(12))) + random.choice(["", "<|endoftext|>x"]) for _ in range(500)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert ids == b"".join(i.to_bytes(4, "little") for i in want)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    own = bpe.ForcedBoundaryBpe(queries.word_bpe_path())
    assert not own.joined.all()
    words = [b"th\xc3\xa9\xff\x01zq", b"aaaa", b"\xe4\xb8\xad\xe6\x96\x87"]
    ids, count = own.encode_words(words)
    each = [own.encode_words([w])[0].tolist() for w in words]
    assert ids.tolist() == sum(each, [])
    assert count.tolist() == [len(x) for x in each]


def test_bpe_query(spark, edges, library):
    got = {r["doc_id"]: r for r in queries.op9_bpe(spark, edges).collect()}
    for doc_id, text, *_ in EDGES["documents"]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def greedy(vocabulary, word):
    n = at = 0
    while at < len(word):
        size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in vocabulary), default=0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


def test_longest_match_equals_greedy():
    random.seed(3)
    for _ in range(800):
        pieces = ["".join(random.choice("abc") for _ in range(random.randrange(1, 6))) + random.choice(["", "</w>"]) for _ in range(random.randrange(1, 14))]
        own = wordpiece.LongestMatch(pieces)
        plain = {p.removesuffix("</w>") + own.end if p.endswith("</w>") else p for p in pieces}
        for _ in range(4):
            word = "".join(random.choice("abc") for _ in range(random.randrange(1, 10)))
            assert own.count(word) == greedy(plain, word + own.end)
    assert own.count("") == 0


@pytest.mark.parametrize("payload", [b"", b"a", b"a" * 64, b"\xff\xfb" * 3000, bytes(range(256)) * 40])
def test_media_round_trip(payload):
    padded = media_mpeg.padded(payload)
    assert len(padded) % 64 == 0
    assert len(padded) > 0
    stored = media_mpeg.write(padded)
    stream = media_mpeg.parse(stored)
    assert media_mpeg.payload_of(stored, stream) == padded
    assert stream.crc_wrong == 0
    assert stream.vbr["frames"] == len(stream.frames)
    assert stream.vbr["bytes"] == len(stored) - stored.index(b"\xff")
    n, d = stream.duration
    assert n * 32000 == d * 1152 * len(stream.frames)


def test_media_resynchronises_and_checks():
    stored = media_mpeg.write(media_mpeg.padded(b"hello" * 1000))
    whole = media_mpeg.parse(stored)
    at = whole.frames[1][0]
    damaged = media_mpeg.parse(stored[:at] + b"junk\xff\xe0\x00" + stored[at:] + b"TAG" + bytes(125))
    assert len(damaged.frames) == len(whole.frames)
    assert damaged.resyncs == 1
    flipped = bytearray(stored)
    flipped[at + 10] ^= 1  # side information
    assert media_mpeg.parse(bytes(flipped)).crc_wrong == 1
    assert media_mpeg.parse(b"no audio at all").frames == []
    # a known header: MPEG-1 layer III, 128 kbit/s, 44100 Hz, no padding
    f = media_mpeg.frame_header(bytes.fromhex("fffb9064"))
    assert (f.size, f.samples, f.kbps, f.rate) == (417, 1152, 128, 44100)
    assert media_mpeg.frame_header(b"\xff\xff\xff\xff") is None


def test_media_query(spark, edges):
    got = {r["doc_id"]: r for r in queries.op4_media(spark, edges).collect()}
    for doc_id, text, *_ in EDGES["documents"]:
        payload = media_mpeg.padded((text or "").encode())
        row = got[doc_id]
        assert (row["n_bytes"], row["payload_bytes"]) == (len((text or "").encode()), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-64:])


def edit_search(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_edit_distance_equals_table():
    random.seed(2)
    for _ in range(1500):
        p = "".join(random.choice("ab c") for _ in range(random.randrange(1, 9)))
        t = "".join(random.choice("ab c") for _ in range(random.randrange(20)))
        assert decontam.EditPattern(p).search(t) == edit_search(p, t)


def test_pieces_cover():
    for n in range(1, 40):
        for k in range(6):
            parts = decontam.pieces(n, k)
            assert parts[0][0] == 0
            assert parts[-1][1] == n
            assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_matches_equal_brute_force():
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(random.randrange(4, 12)))) for i in range(12)]
    matcher = decontam.Matcher(items, 0.1)
    found = 0
    for _ in range(60):
        i, leak = random.choice(items)
        leak = list(leak)
        for _ in range(random.randrange(0, 5)):
            leak[random.randrange(len(leak))] = random.choice("abcxyz ")
        text = " ".join(word() for _ in range(10)) + " " + "".join(leak).upper() + "\n " + word()
        want = {}
        for item_id, item in items:
            d, _ = edit_search(decontam.plain(item), decontam.plain(text))
            if d <= int(0.1 * len(decontam.plain(item))):
                want[item_id] = d
        got = {m[0]: m[1] for m in matcher.matches(text)}
        assert got == want
        found += len(want)
    assert found > 20


def test_decontamination_query(spark, edges):
    rows = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, edges).collect()}
    assert rows == {(4, 1), (5, 1), (6, 1), (11, None)}


def test_item_blocks(spark):
    items = spark.createDataFrame([(i, "some text number %d" % i) for i in range(20)], "item_id long, text string")
    blocks = list(decontam.item_blocks(items, 60))
    assert len(blocks) > 3
    assert sorted(i for b in blocks for i, _ in b) == list(range(20))


def test_machine_equals_pairwise_sum():
    import numpy as np

    random.seed(1)
    r = np.random.default_rng(1)
    model = quality_fm.Model(0.3, r.normal(size=quality_fm.SIZE), r.normal(size=(quality_fm.SIZE, quality_fm.RANK)))
    texts = ["a b c a", "", "Words of some TEXT, with 3 numbers!", None]
    index, value, starts = quality_fm.features(texts)
    got = model.logits(index, value, starts)
    for row in range(len(texts)):
        i, v = index[starts[row] : starts[row + 1]], value[starts[row] : starts[row + 1]]
        slow = 0.3 + sum(model.weights[i] * v) + sum(model.factors[i[a]] @ model.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert abs(got[row] - slow) < 1e-6


def test_quality_is_learned(spark):
    folder = DATA.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = [r for r in queries.op3_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_without_labels(spark, make_tables):
    folder = make_tables(documents=[(1, "some text", "en", "s", 1)])
    row = queries.op3_quality(spark, folder).first()
    assert (row["score"], row["predicted"]) == (0.5, 1) or abs(row["score"] - 0.5) < 0.2


def test_out_of_place_distance():
    profiles = language_id.Profiles.of({"x": [1, 2, 3], "y": [3, 2, 1]}, 3)
    assert profiles.languages == ["x", "y"]
    grams, counts = language_id.ngrams("ab ab")
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True))[ord("a")] == 2
    assert profiles.identify("") == ("und", 0.0)
    assert profiles.identify(None) == ("und", 0.0)
    assert language_id.Profiles.of({}).identify("text") == ("und", 0.0)
    same = language_id.Profiles.of({"b": language_id.ranking(*language_id.ngrams("hello")).tolist(), "a": language_id.ranking(*language_id.ngrams("hello")).tolist()})
    assert same.identify("hello") == ("a", 1.0)  # a tie


def test_language_is_learned(spark):
    folder = DATA.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = [r for r in queries.op2_language_id(spark, folder).collect() if r["held_out"]]
    assert len(rows) > 150
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.97


def test_long_text_is_whole(spark, edges):
    got = {r["doc_id"]: r["n_words"] for r in queries.op6_token_counts(spark, edges).collect()}
    assert got[4] == len(LONG.split())
