"""Conversation repair, phrase collocations and byte-level BPE against brute force, with their edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from riskgraph.llm import bytepair, catalog, conversations, phrases

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, h string, audit int, conv string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- 11: conversations -----------------------------------------------------------------------------


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        yield from [] if k == 0 else [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def repair(rows):
    """The contract read literally, for one conversation after damage: cheapest edits by a table over whole audit strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    for (_, _, role, _), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for s in range(4):
            options = [(best[s][0] + 2, "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (s, role[:1]) in keep:
                    to = best[keep[s, role[:1]]]
                    options.append((to[0] + extra, "K" + to[1]))
                options.append((best[due[s]][0] + 1 + extra, "R" + best[due[s]][1]))
            now[s] = min(options)
        for _ in range(3):
            now = {s: min(now[s], (now[due[s]][0] + 5, "I" + now[due[s]][1])) for s in now}
        best = now
    cost, audit = best[0]
    state, left, said = 0, list(rows), []
    for letter in audit:
        row = left.pop(0) if letter != "I" else None
        if letter == "D":
            continue
        state = keep[state, row[2][:1]] if letter == "K" else due[state]
        role = row[2] if letter == "K" else {2: "user", 3: "assistant"}[state]
        said.append(f"{role}:{row[3] if row else ''}")
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), said


def brute(rows, hurt=True):
    groups = {r[0]: [] for r in rows}
    for r in damage(rows) if hurt else ((c, t, *(" " if x is None else x for x in rx)) for c, t, *rx in rows):
        groups[r[0]].append(r)
    return {c: repair(g) for c, g in groups.items()}


def invented(seed, n):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "User", "tool", None]
    texts = ["Hi.", "Go on", "", " \t", None, "Why?", "Yes!", "No. ", "a:b.\n", "é", "x" * 5000 + "."]
    return [
        (pick.choice([None, *range(n // 8)]), pick.choice([None, *range(-2, 9)]), pick.choices(roles, [8, 8, 3, 1, 1, 1])[0], pick.choices(texts, [9, 3, 1, 1, 1, 9, 5, 2, 1, 1, 1])[0])
        for _ in range(n)
    ]


def reports(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reports(catalog.op11_conversations(spark, SF)) == {c: v[:-1] for c, v in brute(rows).items()}


@pytest.mark.parametrize("hurt", [True, False])
def test_repair_of_odd_rows_matches_brute_force(spark, hurt):
    rows = invented(7, 1200)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)
    want = brute(rows, hurt)
    df = conversations.damaged(df) if hurt else df
    assert reports(conversations.repair_report(df)) == {c: v[:-1] for c, v in want.items()}
    got = {}
    for r in sorted(conversations.repaired_turns(df).collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {c: v[-1] for c, v in want.items() if v[-1]}


def test_repair_of_a_giant_conversation_spans_chunks(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"{t}.") for t in range(3 * conversations.CHUNK)] + [(1, 5, "tool", "same.")] * 9000 + [(2, 0, "user", "a.")]
    df = spark.createDataFrame([(*r, "", 0, "") for r in rows], TURNS)
    assert reports(conversations.repair_report(df)) == {c: v[:-1] for c, v in brute(rows, False).items()}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversations.repair_report(conversations.damaged(none)).count() == 0 and conversations.repaired_turns(none).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = conversations.damaged(spark.createDataFrame([(gone, 0, "user", "a.", "", 0, "")], TURNS))
    assert reports(conversations.repair_report(only)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- 12: phrases -----------------------------------------------------------------------------------


def mined(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    cover = Counter()
    for (lang, p), c in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                cover[lang, p[i : i + k]] = max(cover[lang, p[i : i + k]], c)
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * cover[lang, p] < 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_phrases_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    assert listed(catalog.op12_phrases(spark, SF)) == mined(rows, 30, 2000)
    assert listed(phrases.collocations(spark.read.parquet(f"{SF}/documents.parquet"), least=3, top=60)) == mined(rows, 3, 60)


def test_phrases_of_odd_texts(spark):
    pick = random.Random(3)
    words = ["a", "B", "b", "Ä", "ä", "1", "\x00", "x-y", "=", " "]
    rows = [(pick.choice(["en", "", None, "und"]), "".join(pick.choice(words) + pick.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(pick.randrange(40)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("fr", " . , "), ("en", "a b " * 20_000), ("en", "a b " * 20_000), ("de", "z" * 300_000)]
    df = spark.createDataFrame([(i, lang, text, 1, "w") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n int, w1 string")
    assert listed(phrases.collocations(df, least=2)) == mined(rows, 2, 2000)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_phrase_ranks_use_all_ties_and_wide_numbers(spark):
    key = [("en", i, i + 1, 0, 0, 2, 10) for i in range(1, 400)]
    df = spark.createDataFrame(key, "lang string, w1 long, w2 long, w3 long, w4 long, len int, a long")
    got = phrases.leading(df, "lang", [df.a.desc(), df.w1.asc()], 300, __import__("pyspark").sql.functions.row_number())
    assert sorted(r.w1 for r in got.collect()) == list(range(1, 301))
    big = 6 * 10**18
    grams = spark.createDataFrame([("en", 1, 0, 0, 0, 1, big + 7), ("en", 2, 0, 0, 0, 1, big), ("en", 1, 2, 0, 0, 2, big)], "lang string, w1 long, w2 long, w3 long, w4 long, len int, f long")
    assert [r.score for r in phrases.weakest_cuts(grams).collect()] == [2_000_000 * big // (2 * big + 7)]


# --- 13: byte-level BPE ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_bytepair_query_matches_the_rank_table_library(spark, reference):
    got = {r.doc_id: tuple(r)[1:] for r in catalog.op13_bytepair(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids, text = reference.encode_ordinary(r.text or ""), (r.text or "").encode()
        assert got[r.doc_id] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text).hexdigest())


def test_bytepair_of_odd_texts(spark, reference):
    pick = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'LL", "1", "é", "é", "👍🏽", "​", "\x00", "\x85", "　", "<|endoftext|>", "---", "漢字", ".", " x"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(1, 40))) for _ in range(800)] + [None, "", " ", "a" * 200_000, "a1" * 30_000, " " * 50_000, "word " * 60_000, "x" * (bytepair.CUT + 5) + " end of it " * 9]
    rows = spark.createDataFrame([(i % 700, t, 1, "e") for i, t in enumerate(texts)] + [(None, "null id", 1, "e")], "doc_id long, text string, ids int, ends string")
    encoded = bytepair.encode_texts(rows, RANKS, public_tokenizers.PATTERN, spans=True)
    want = Counter((i, packed(reference.encode_ordinary(t or ""))) for i, t in [(i % 700, t) for i, t in enumerate(texts)] + [(None, "null id")])
    assert Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect()) == want
    plain = bytepair.encode_texts(rows, RANKS, public_tokenizers.PATTERN)
    back = bytepair.decode_ids(plain, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter([(i % 700, t or "") for i, t in enumerate(texts)] + [(None, "null id")])
    assert all(r.head == r.tail == 0 and bytes(r.decoded).decode() == r.text and len(r.ids) == 4 * r.n_tokens for r in back)


def test_bytepair_spans_cover_the_characters_of_each_token(spark, reference):
    texts = ["naïve  café 👍🏽 x", "漢字かな 12\n\n'll", "plain words, and more ", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bytepair.encode_texts(rows, RANKS, public_tokenizers.PATTERN, spans=True).collect():
        text, at = texts[r.doc_id], 0
        ends = np.cumsum([len(c.encode()) for c in text])
        for i, a, b in zip(np.frombuffer(r.ids, "<u4").tolist(), r.starts, r.ends):
            size = len(reference.decode_single_token_bytes(i))
            assert a == np.searchsorted(ends, at, side="right") and b == np.searchsorted(ends, at + size - 1, side="right") + 1
            at += size
        assert at == len(text.encode())


def test_bytepair_blocks_may_cut_characters(spark, reference):
    text = "a👍🏽漢b" * 40
    ids = reference.encode_ordinary(text)
    cuts = [*range(0, 60), *range(60, len(ids), 5), len(ids)]
    blocks = [(a, b - a, packed(ids[a:b])) for a, b in zip(cuts, cuts[1:])]
    df = spark.createDataFrame([*blocks, (10**6, 0, None)], "doc_id long, n_tokens long, ids binary")
    back = sorted(bytepair.decode_ids(df, RANKS, public_tokenizers.PATTERN).collect(), key=lambda r: r.doc_id)
    assert b"".join(bytes(r.decoded) for r in back) == text.encode() and any(r.head for r in back) and any(r.tail for r in back)
    assert all(bytes(r.decoded)[r.head : len(r.decoded) - r.tail].decode() == r.text for r in back)
    assert bytepair.cut_ends(b"\x8d") == (1, 0) and bytepair.cut_ends("é".encode()) == (0, 0) and bytepair.cut_ends(b"x\xf0\x9f") == (0, 2)


def test_bytepair_of_nothing(spark):
    assert bytepair.round_trip(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bytepair.decode_ids(spark.createDataFrame([(1, 1, packed([60_000]))], "doc_id long, n_tokens long, ids binary"), RANKS, public_tokenizers.PATTERN).collect()
