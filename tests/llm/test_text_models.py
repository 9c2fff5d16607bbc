"""Tokens, packing, language, personal data, media: plain versions, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, media, packing, pii, token_counts
from strandline.llm.tokenise import Tokeniser, groups

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "²", "!", "'", "'s", "'re", "　", "\xa0", "文", "😀", "\x85", "\x1c", "-", "<|endoftext|>"]


@pytest.fixture(scope="module")
def coder():
    return Tokeniser(PATH)


def mixed(rng, n=12):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, n)))


def test_ids_equal_the_library(coder):
    rng = random.Random(1)
    texts = [mixed(rng) for _ in range(3000)] + ["", "plain words here", "x" * 5000]
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == coder.lib.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_a_fresh_library(coder):
    from tokenizers import Tokenizer

    fresh, texts = Tokenizer.from_file(PATH), ["a<|endoftext|>b", "plain", "it's<|endoftext|>", "<|endoftext", "|>", "<|endoftext|>"]
    for batch in (texts, *([x] for x in texts)):
        ids, counts = coder.encode(batch)
        assert ids.tolist() == [i for x in batch for i in fresh.encode(x, add_special_tokens=False).ids]
        assert counts.tolist() == [len(fresh.encode(x, add_special_tokens=False).ids) for x in batch]
    assert coder.encode(["a<|endoftext|>b"])[0].tolist() == [64, 50256, 65]
    assert token_counts.token_bytes(PATH)[[64, 50256, 65]].tolist() == [1, 13, 1]


def test_table_is_emptied_when_full(coder, monkeypatch):
    from strandline.llm import tokenise

    monkeypatch.setattr(tokenise, "TABLE_WORDS", 64)
    small = Tokeniser(PATH)
    for k in range(5):
        text = " ".join(f"w{k}q{i}" for i in range(15))
        assert small.encode([text])[0].tolist() == small.lib.encode(text, add_special_tokens=False).ids
    assert small.words <= 64


def test_a_text_may_have_more_words_than_the_table(monkeypatch):
    from strandline.llm import tokenise

    monkeypatch.setattr(tokenise, "TABLE_WORDS", 64)
    small = Tokeniser(PATH)
    texts = ["first", " ".join(f"w{i}x" for i in range(500)), "last w3x"]
    ids, counts = small.encode(texts)
    whole = [small.lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for x in whole for i in x] and counts.tolist() == [len(x) for x in whole]


def test_groups_cover_all():
    texts = ["abc"] * 7
    assert [x for g in groups(texts, 6) for x in texts[g]] == texts


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randint(1, 300) for _ in range(200)]
    parts = packing.difference(sizes, 16)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(200)) and max(sums) - min(sums) <= 5
    assert packing.difference([], 3) == [[], [], []] and packing.difference([8, 7, 6, 5, 4], 2) is not None
    assert len(packing.spread([600, 600, 600], 1024)) == 3  # three windows, as two of these don't share one


def test_packing_is_whole(spark, coder):
    rng = random.Random(7)
    rows = [(i, mixed(rng, 800)) for i in range(60)] + [(100, None), (101, ""), (102, "word " * 5000), (102, "word " * 5000), (None, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, with_ids=True).collect()
    windows, tokens = {}, 0
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        windows.setdefault(r.sequence_id, []).append(r)
        tokens += r.length
    assert tokens == sum(len(coder.lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, t in rows[:60] + [(100, None)]:
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == [*coder.lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert all(r.doc_tokens == sum(p.length for p in pieces) for r in pieces)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_tokens_are_allotted_by_most_bytes(coder):
    rng, sizes = random.Random(4), token_counts.token_bytes(PATH)
    for n in range(300):
        text = mixed(rng, 25).replace("<|endoftext|>", "z")
        ids = coder.lib.encode(text, add_special_tokens=False).ids
        ends = np.cumsum(sizes[np.array(ids, int)])
        at = [len(text[:i].encode()) for i in range(len(text) + 1)]
        starts = token_counts.line_starts(text) if n % 2 else np.array(sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))[::2][: (len(text) + 1) // 2], int)
        stops = np.append(starts[1:], len(text))
        a, b = np.array([at[i] for i in starts], int), np.array([at[i] for i in stops], int)
        section, _ = token_counts.allot(ends, a, b)
        for j, (lo, hi) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            shares = [min(y, hi) - max(x, lo) for x, y in zip(a, b)]
            best = max(shares, default=0)
            assert section[j] == (shares.index(best) if best > 0 else -1)


def test_section_counts_add_up(spark, coder):
    rows = [(1, "a b\n\nc é\n", [(0, 3), (3, 9)]), (2, None, None), (3, "", []), (4, "x\ny", [(2, 3)])]
    table = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start: long, end: long>>")
    got = token_counts.count_tokens(table, PATH).collect()
    for i, t, _ in rows:
        own = [r for r in got if r.doc_id == i]
        assert sum(r.n_tokens for r in own) == len(coder.lib.encode(t or "", add_special_tokens=False).ids) and own[-1].end == len(t or "")
    given = token_counts.count_tokens(table, PATH, sections_col="sections").collect()
    assert sorted((r.doc_id, r.section, r.n_tokens) for r in given) == [(1, 0, 2), (1, 1, 4), (4, 0, 1)] or sum(r.n_tokens for r in given if r.doc_id == 1) == len(coder.lib.encode("a b\n\nc é\n", add_special_tokens=False).ids)


WORDS = {"en": ["the", "thing", "shore", "with", "that", "when"], "fr": ["être", "l'eau", "où", "nous", "ça", "près"], "de": ["über", "straße", "zwischen", "und", "schön", "nicht"]}


def test_language_accuracy_and_rejection(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(rng.choices(list(WORDS), k=600))]
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, "12 !!", "en"), (9003, "Ж" * 200, None), (None, "the thing", None)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = {r.doc_id: r for r in langid.identify(table, model).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 100 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.98 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (9000, 9001, 9002))
    assert got[9003].rejected and got[9003].lang_pred in WORDS and got[None].lang_pred == "en"
    assert sum(r.rejected for r in got.values()) <= 6
    kept = langid.accepted(table, model)
    assert kept.columns == table.columns and not kept.filter("doc_id = 9002").count() and kept.count() >= 598
    empty = table.limit(0)
    assert langid.fit(empty) is None and langid.identify(empty, None).collect() == []
    assert {r.lang_pred for r in langid.identify(table.limit(3), None).collect()} == {"und"}


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15])


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(2)
    for letters in ("ab@@..--+ ()12345 é%_", "0123456789 -.+256"):
        for _ in range(20000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_of_long_runs_take_little_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 100_000) == []


def test_spans_found(spark):
    rows = [(1, "mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, +1 (212) 555-0100."), (2, None), (3, ""), (4, "call (212) 555-0101 now"), (5, "plain"), (5, "plain")]
    rows += [(100 + i, f"call me: +1 (212) 555-01{i:02d} or (212) 555-02{i:02d}") for i in range(60)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = "email:5:13,ip:17:25,card:32:51,phone:53:70"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1) and got[1].spans == base
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[4].spans == "phone:5:19" and got[4].n_phone == 0
    assert got[2].spans == got[3].spans == got[5].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_secrets_are_added_and_failed_numbers_are_not(spark):
    rng = random.Random(12)
    run = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    said = lambda i, x: f"words before {i} {x} and after"
    rows, secrets = [], {}
    for i in range(200):
        kind = i % 5
        value = run(40)
        text = said(i, {0: f'token = "{value}"', 1: f"api_key: {value}", 2: f"order 12345678901234{i:04d}"}.get(kind, "nothing at all"))
        if kind == 3:
            text = said(i, f"mail a{i}@b.de or +1 (212) 555-0{i:03d}")
        rows.append((i, text))
        if kind < 2:
            secrets[i] = f"secret:{text.index(value)}:{text.index(value) + 40}"
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.spans for i, r in got.items() if "secret" in r.spans} == secrets
    assert all(got[i].n_spans == got[i].n_card for i in range(2, 200, 5)) and all(got[i].n_spans == 0 for i in range(4, 200, 5))


def test_a_step_of_maximisation_is_bayes_rule():
    hit, false, share = np.array([0.9, 0.6]), np.array([0.2, 0.5]), 0.3
    for v, (yes, no) in {(1, 0): (0.9 * 0.4, 0.2 * 0.5), (1, -1): (0.9, 0.2), (-1, 0): (0.4, 0.5), (-1, -1): (1, 1)}.items():
        assert abs(pii.posterior([v], hit, false, share)[0] - 0.3 * yes / (0.3 * yes + 0.7 * no)) < 1e-9


def test_maximisation_finds_the_reliable_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = tuple(int(y if rng.random() < q else not y) for q in (0.95, 0.9, 0.55))
        counts[v] = counts.get(v, 0) + 1
    hit, false, share = pii.maximise(sorted(counts.items()))
    assert hit[0] > 0.85 and false[0] < 0.2 and hit[0] - false[0] > hit[2] - false[2] and 0.25 < share < 0.55


def encode_baseline(pixels):
    """A grey baseline image with flat quantisation and fixed-length codes; for tests of the reader."""
    dc, ac = list(range(12)), [0] + [(r << 4) | s for r in range(16) for s in range(1, 11)] + [0xF0]
    bits = ""

    def number(v):
        k = abs(v).bit_length()
        return k, format(v if v > 0 else v + (1 << k) - 1, f"0{k}b") if k else ""

    last = 0
    for y in range(0, pixels.shape[0], 8):
        for x in range(0, pixels.shape[1], 8):
            c = np.rint(media._C @ (pixels[y : y + 8, x : x + 8].astype(float) - 128) @ media._C.T / 4).astype(int).reshape(64)[media.ZIGZAG]
            k, extra = number(int(c[0]) - last)
            last = int(c[0])
            bits += format(dc.index(k), "04b") + extra
            run = 0
            for v in c[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += format(ac.index(0xF0), "08b")
                    run -= 16
                k, extra = number(int(v))
                bits += format(ac.index((run << 4) | k), "08b") + extra
                run = 0
            if run:
                bits += format(0, "08b")
    bits += "1" * (-len(bits) % 8)
    coded = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    tables = bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(dc) + bytes([16]) + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac)
    h, w = pixels.shape
    return b"\xff\xd8" + seg(0xDB, bytes([0] + [4] * 64)) + seg(0xC4, tables) + seg(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + coded + b"\xff\xd9"


def test_baseline_frames_are_decoded():
    y, x = np.mgrid[0:24, 0:32]
    pixels = (128 + 60 * np.sin(y / 5) + 40 * np.cos(x / 3)).astype(np.uint8)
    data = media.write_avi([encode_baseline(pixels)] * 3, 32, 24)
    frames = media.decode_frames(media.read_avi(data)["images"])
    assert len(frames) == 3 and np.abs(frames[0].astype(int) - pixels).max() <= 8


def test_lossless_frames_by_any_predictor_path():
    rng = np.random.default_rng(1)
    for n in (64, 4096, 10_048):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        avi = media.read_avi(media.to_media(data))
        frames = media.decode_frames(avi["images"])
        assert b"".join(f.tobytes() for f in frames)[:n] == data and avi["note"] == b"payload=%d" % n
    image = media.parse(avi["images"][0])
    for table in image["huffman"].values():
        table.fixed = lambda: False
    assert (media.decode_lossless(image) == frames[0]).all()


def test_avi_without_index_and_broken_files():
    data = media.to_media(b"abc" * 2000)
    cut = data[: data.index(b"idx1")]
    assert media.read_avi(cut)["images"] == media.read_avi(data)["images"]
    for bad in (b"", b"RIFF", data[:20]):
        with pytest.raises(ValueError):
            media.read_avi(bad)
    with pytest.raises(ValueError):
        media.parse(b"\xff\xd8\xff\xd9")


def test_shots_follow_histograms():
    flat = lambda v, n: [np.full((32, 64), v, np.uint8)] * n
    assert media.shots(flat(20, 10) + flat(200, 7) + flat(90, 5)) == [(0, 9), (10, 16), (17, 21)]
    assert media.shots(flat(5, 4)) == [(0, 3)] and media.shots([]) == []


def test_media_columns_round_trip(spark):
    rows = [(1, "Grüße " * 700), (2, None), (3, ""), (4, "x" * 64), (5, "x" * 64)]
    got = {r.doc_id: r for r in media.describe(media.store(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[2].feature == got[3].feature
    timed = media.clips(media.describe(media.store(spark.createDataFrame(rows[:1], "doc_id long, text string")))).orderBy("clip").collect()
    assert timed[0].start_ms == 0 and timed[-1].end_ms == 40 * (timed[-1].last_frame + 1)
