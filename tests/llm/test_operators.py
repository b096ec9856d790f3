"""Operators for language-model data: edge cases, brute force, round trips and held-out accuracy."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosa.llm import neighbors as N
from mnemosa.llm import queries
from mnemosa.llm.boosting import fit
from mnemosa.llm.conversations import rebuild
from mnemosa.llm.mixing import mix_sources, plan, reached_shares, sized
from mnemosa.llm.privacy import Scanner, estimate, find_personal, redact, replace, resolve
from mnemosa.llm.quality import HOLDOUT, classify, features, statistics, weak_label
from mnemosa.llm.tokens import TOKENIZERS, Encoder, with_ids, with_token_count
from mnemosa.llm.topn import top_facts
from mnemosa.sources.tables import read_table
from tests.oracle import compare

T0 = dt.datetime(2023, 7, 1)
s = lambda n: T0 + dt.timedelta(seconds=n)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    sql = queries.SQL.get(name)
    if sql is None:
        queries.QUERIES[name](spark, small).count()
        return
    rows, ours, theirs, names = compare(spark, small, queries.QUERIES[name], sql)
    assert not names and not ours and not theirs, (rows, list(ours)[:3], list(theirs)[:3])


# 1 -----------------------------------------------------------------------------------------

FACT = "uuid string, entity_id string, significance int, reinforced_count int, updated_at timestamp_ntz, rank_no string, `_sig` string, `_rn` int"


def test_top_facts(spark):
    rows = [(f"u{i:04d}", "hot", i % 3 + 1, i % 7, T0, "x", "x", 1) for i in range(2000)]
    rows += [("a", "E ", None, None, s(1), "", "", 1), ("b", "e", 11, 2, s(1), "", "", 1), ("c", "e", 5, 2, s(1), "", "", 1), ("d", "e", 10, None, s(1), "", "", 1), ("d", "e", 1, 9, s(2), "", "", 1), ("d", "e", 1, 9, s(2), "", "", 1), ("f", None, 9, 9, s(1), "", "", 1), ("g", " ", 9, 9, s(1), "", "", 1), (None, "e", 9, 9, s(1), "", "", 1)]
    df = spark.createDataFrame(rows, FACT)
    got = {}
    for r in top_facts(df).orderBy("entity_id", "rank_no").collect():
        got.setdefault(r.entity_id, []).append(r.uuid)
    want = [x[0] for x in sorted(rows[:2000], key=lambda x: (-x[2], -x[3], x[0]))[:5]]
    assert got == {"hot": want, "e": ["b", "c", "a", "d"]}
    assert top_facts(df.limit(0)).count() == 0
    assert "WindowGroupLimit" in top_facts(df)._jdf.queryExecution().toString()


# 4 -----------------------------------------------------------------------------------------

MESSAGE = "uuid string, conversation_id string, role string, content string, created_at timestamp_ntz, side string, at string"


def talk(spark, rows, **k):
    full = [(u, c, r, t, None if a is None else s(a), "x", "x") for u, c, r, t, a in rows]
    out = {}
    for r in rebuild(spark.createDataFrame(full, MESSAGE), **k).orderBy("conversation_id", "turn_no").collect():
        out.setdefault(r.conversation_id, []).append(r.uuid)
    return out


def test_conversations(spark):
    rows = [
        ("1", "C1 ", "User", "hi", 0), ("1", " c1", "User", "hi", 0), ("2", "c1", " bot", "yo", 0), ("3", "c1", "human", "a", 5), ("4", "c1", "human", " a ", 6), ("5", "c1", "AI", "b", 7), ("6", "c1", "system", "x", 8), ("7", "c1", "user", "\xa0 \n", 9), ("8", "c1", "tool", None, None),
        ("a1", "starts", "assistant", "x", 0), ("a2", "starts", "user", "x", 1), ("a3", "starts", "assistant", "x", 2),
        ("b1", "ends", "user", "x", 0), ("d1", "twice", "user", "x", 0), ("d2", "twice", "user", "y", 1), ("d3", "twice", "bot", "y", 2),
        ("e1", "role", "user", "x", 0), ("e2", "role", "bot", "x", 1), ("e3", "role", "boss", "x", 2), ("f1", "norole", "user", "x", 0), ("f2", "norole", "bot", "x", 1), ("f3", "norole", None, "x", 2),
        ("g1", "notime", "user", "x", 0), ("g2", "notime", "bot", "x", 1), ("g3", "notime", "user", "x", None), ("h1", None, "user", "x", 0), ("i1", "empty", "user", "", 0), ("i2", "empty", "system", "z", 0),
        ("j1", "again", "user", "thanks", 0), ("j2", "again", "bot", "ok", 1), ("j3", "again", "user", "thanks", 2), ("j4", "again", "bot", "ok", 3), (None, "again", "user", "?", 4),
    ]
    assert talk(spark, rows) == {"c1": ["1", "2", "3", "5"], "again": ["j1", "j2", "j3", "j4"]}
    assert talk(spark, []) == {}
    late = [("1", "late", "user", "a", 10), ("2", "late", "bot", "b", 8), ("3", "late", "user", "c", 20), ("4", "late", "bot", "d", 19)]
    assert talk(spark, late) == {} and talk(spark, late, max_offset_us=3_000_000) == {"late": ["1", "2", "3", "4"]}
    never = [("1", "n", "user", "a", 10), ("2", "n", "bot", "b", 2), ("3", "n", "user", "c", 10), ("4", "n", "bot", "d", 40)]
    assert talk(spark, never, max_offset_us=60_000_000) == {}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conversations_equal_walk(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [f"c{i}" for i in range(60)]:
        n = r.randint(1, 4)
        for i in range(n):
            t = i * 10
            for role in ("user", "bot"):
                for _ in range(r.choice([1, 1, 1, 1, 2])):
                    if r.random() < 0.97:
                        rows.append((f"{c}-{len(rows)}", c, role, r.choice("xy"), t + r.choice([0, 0, 0, 1])))
                t += r.choice([0, 1])
    rows += [(f"h{i:04d}", "hot", ("user", "bot")[i % 2], str(i), i // 2) for i in range(1500)]
    want = {}
    for c in {x[1] for x in rows}:
        mine = sorted((x for x in rows if x[1] == c), key=lambda x: (x[4], x[2] != "user", x[0]))
        kept = [x for i, x in enumerate(mine) if not i or (x[2], x[3]) != (mine[i - 1][2], mine[i - 1][3])]
        if len(kept) % 2 == 0 and all((x[2] == "user") == (i % 2 == 0) for i, x in enumerate(kept)):
            want[c] = [x[0] for x in kept]
    assert "hot" in want and talk(spark, rows) == want


# 5 -----------------------------------------------------------------------------------------

VECTOR = "uuid string, embedding array<float>, model string, updated_at timestamp_ntz, grp string, vec int"


def planted(n, d, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    near = x[: n // 4] + 0.2 * r.normal(size=(n // 4, d)) * np.linalg.norm(x[: n // 4], axis=1, keepdims=True) / d**0.5
    return np.concatenate([x, near]).astype(np.float32)


def test_similar_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 64)
    monkeypatch.setattr(N, "SPLIT", 100)
    x = planted(1600, 16)
    rows = [(f"u{i:05d}", v.tolist(), "m", T0, "clash", 1) for i, v in enumerate(x)]
    old = [("u00000", (-x[0]).tolist(), "m", T0 - dt.timedelta(1), "", 1), ("u00001", x[5].tolist(), "m", T0 - dt.timedelta(1), "", 1)]
    odd = [("n1", None, "m", T0, "", 1), ("n2", [], "m", T0, "", 1), ("n3", [0.0] * 16, "m", T0, "", 1), ("n4", x[0][:8].tolist(), "m", T0, "", 1), ("n5", x[0].tolist(), "other", T0, "", 1), ("n6", [float("nan")] + [1.0] * 15, "m", T0, "", 1), (None, x[0].tolist(), "m", T0, "", 1), ("n7", [2.0], "one", T0, "", 1), ("n8", [3.0], "one", T0, "", 1)]
    df = spark.createDataFrame(rows + old + odd + rows[:3], VECTOR)
    got = {(r.a, r.b) for r in N.similar_pairs([(N.usable_vectors(df, "f", "embedding", "model", "updated_at"), True)], 0.9).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    want = {(f"u{a:05d}", f"u{b:05d}") for a, b in zip(i, j)} | {("n7", "n8")}
    assert got <= want and len(got) >= 0.97 * len(want) and ("n7", "n8") in got


def test_similar_pairs_of_few_copies_and_none(spark):
    rows = [(f"c{i}", [1.0, 2.0], "", T0, "", 1) for i in range(6)]
    df = spark.createDataFrame(rows, VECTOR)
    pairs = lambda d: N.similar_pairs([(N.usable_vectors(d, "f", "embedding", "model", "updated_at"), True)], 0.9).count()
    assert pairs(df) == 15 and pairs(df.limit(0)) == 0


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "SEARCH_CELL", 128)
    x = planted(2400, 32, 3)
    df = spark.createDataFrame([(f"u{i:05d}", v.tolist(), "m", T0, "", 1) for i, v in enumerate(x)], VECTOR)
    found = N.nearest([(N.usable_vectors(df, "f", "embedding", "model"), False)], F.substring("id", 2, 5).cast("int") % 50 == 0, 10, probes=16).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -1)
    hit = [(int(r.query[1:]), int(r.neighbor[1:])) for r in found]
    asked = sorted({q for q, _ in hit})
    assert asked == list(range(0, 3000, 50))
    top = {q: set(np.argsort(-sims[q])[:10].tolist()) for q in asked}
    recall = sum(n in top[q] for q, n in hit) / (10 * len(asked))
    assert recall >= 0.9, recall


# 7 -----------------------------------------------------------------------------------------

GIVEN = ["Tamolt", "Velna", "Jean-Brivel", "Linden", "Marlowe", "Ireven", "Pasado"]
TEXTS = {
    "You can reach Tamolt Sarquist at +1-808-555-0108 or KORVEN_K7@UNI-TESSARIN.TEST.": {("NAME", "Tamolt Sarquist"), ("PHONE", "+1-808-555-0108"), ("EMAIL", "KORVEN_K7@UNI-TESSARIN.TEST")},
    "User's passport is 954-96-6824 and is held by Velna Korstead.": {("ID", "954-96-6824"), ("NAME", "Velna Korstead")},
    "I live at 38B Quince Lane, Oakhollow 00038.": {("ADDRESS", "38B Quince Lane, Oakhollow 00038")},
    "Meine Adresse ist Ulmenstraße 202a, 00202 Kestrel Bay.": {("ADDRESS", "Ulmenstraße 202a, 00202 Kestrel Bay")},
    "J'habite au 26 rue des Sorbiers, appt 15.": {("ADDRESS", "26 rue des Sorbiers, appt 15")},
    "Send it to <velna.korstead at mail dot example dot org> please.": {("EMAIL", "velna.korstead at mail dot example dot org")},
    "new number: two one two five five five zero one six four": {("PHONE", "two one two five five five zero one six four")},
    "We'll meet at Linden tea Friday; Marlowe blue paint was worth it.": set(),
    "Parcel 71516-586-T left Larkmoor at 12:15 with 27,747,404 rows of icon@2x.png since 2023-05-06.": set(),
    "": set(),
}


def test_personal_information(spark):
    names = spark.createDataFrame([(g,) for g in GIVEN] + [(None,)], "name string")
    rows = [("f", f"r{i}", t) for i, t in enumerate(TEXTS)] + [("f", "r0", next(iter(TEXTS))), ("f", "n", None)]
    # plain texts from which reliabilities can be learned
    rows += [("f", f"x{i}", t) for i, t in enumerate(list(TEXTS) * 8)]
    df = spark.createDataFrame(rows, "field string, uuid string, text string")
    got = {}
    for r in find_personal(df, names).collect():
        got.setdefault(r.uuid, []).append((r.kind, r.found_text))
    for i, (text, want) in enumerate(TEXTS.items()):
        assert sorted(got.get(f"r{i}", [])) == sorted(want), text
    red = {r.uuid: r.text for r in redact(df, names).filter("uuid IN ('r0', 'r7', 'r9', 'n')").collect()}
    assert red["r0"] == "You can reach [NAME] at [PHONE] or [EMAIL]." and red["r7"] == list(TEXTS)[7] and red["r9"] == "" and red["n"] is None
    assert find_personal(df.limit(0), names).count() == 0


def test_spans_round_trip_and_long_text():
    scanner = Scanner(GIVEN, ["sarquist"])
    text = ("My name is Tamolt Sarquist. " + "filler words without anything of note " * 20_000 + "mail me: a.b@example.org")
    found = scanner.scan(text)
    scores = {(k, v): 1.0 for k, _, _, v in found}
    items = resolve(found, scores)
    assert [(k, text[a:b]) for k, a, b in items] == [("NAME", "Tamolt Sarquist"), ("EMAIL", "a.b@example.org")]
    assert replace(text, items).startswith("My name is [NAME]. filler") and replace(text, []) == text
    assert estimate({}) == {}


def test_family_names_from_all_texts(spark, monkeypatch):
    import mnemosa.llm.privacy as P

    letters = "abcdefghij"
    families = [f"Korov{letters[i // 10]}{letters[i % 10]}r" for i in range(40)]
    rows = [t for n in families for t in (f"My name is Tamolt {n}.", f"I met Velna {n} again.", f"The form says Casilde {n} from the north.")]
    rows += ["You met Tamolt Bogusson."] * 3
    filler = spark.range(100_000).selectExpr("'f' AS field", "concat('n', id) AS uuid", "concat('the ', id, ' rows were counted') AS text")
    df = spark.createDataFrame([("f", f"r{i}", t) for i, t in enumerate(rows)], "field string, uuid string, text string").unionByName(filler)
    names = spark.createDataFrame([(g,) for g in GIVEN], "name string")
    scanner, family = P.build_scanner(df, names)
    assert scanner.family == {n.lower() for n in families} and family is None and {"rows", "were", "counted"} <= scanner.common
    found = {tuple(r) for r in find_personal(df, names).collect()}
    assert {f"Casilde {n}" for n in families} <= {x[3] for x in found}
    red = {tuple(r) for r in redact(df, names).collect()}
    monkeypatch.setattr(P, "LEXICON_MOST", 10)
    assert P.build_scanner(df, names)[1].count() == 40
    assert {tuple(r) for r in find_personal(df, names).collect()} == found
    assert {tuple(r) for r in redact(df, names).collect()} == red


def test_checks_are_no_narrower_than_patterns(monkeypatch):
    import itertools
    import re

    import mnemosa.llm.privacy as P

    R = P.R
    intro = {p: p.replace("\\", "") for p in re.split(r"\|(?![^()]*\))", R.NAME_INTRO)}
    intro |= {"name": "my name's", "name is": "NAME IS", "contact": "contact person:"}
    names = [re.sub(r"\(\?:.*", "", x) + " " + t + n for x in intro.values() for t in ("", "M. ", "Don ") for n in ("Briero", "Wenna Korovar", "C. Osterovar")]
    names += [x + "Briero" for x in ("my name's", "name is ", "contact is ", "contact person: ", "Je m'appelle ", "best,")] + [f"saw {t}{d} Briero" for t in R.TITLES.split("|") for d in ("", ".")]
    streets = [f"{n} Alder {t}{e}" for n in ("12", "5b") for t in R._TYPES_EN.split("|") for e in ("", "'s", "-side")]
    streets += [f"Linden{t}{d} 4" for t in R._ENDINGS_DE.split("|") for d in ("", ".")] + [f"{t} Hof 3" for t in R._STARTS_DE.split("|")] + ["Martin-Luther-Straße 7", "LINDENSTRASSE 5"]
    streets += [f"7{b} {t.replace(chr(92), '')} de la Tour" for b in (",", " bis") for t in R._TYPES_FR.split("|")] + [f"{t.replace(chr(92), '').replace('?', '')}{b}Mayor 5" for t in R._TYPES_ES.split("|") for b in ("", " ")]
    streets += ["pobox 12", "P.O.Box 12", "p. o. box 12", "Postfach 3", "apartado 4", "Apartado de correos 4", "BP 9", "boîte postale 9", "casilla 8"]
    mails = [f"korven{a}tessarin{d}test" for a, d in itertools.product(("@", " @ ", "(at)", " [ at ] ", " {arroba} ", " at ", " arroba "), (".", " dot ", "(dot)", " [punkt] ", " point ", " punto "))]
    numbers = ["AB123456C", "AB 12 34 56 C", "AB 1234 56 C", "C01X00T47", "L01X0Z2T4", "X-1234567-L", "12.345.678-Z", "1 84 12 76 451 089 46", "954-96-6824", "21 0000 1111", "12 345 678 901", "12 345678 A 123", "123456789", "+49 (0) (30) 123 4567", "0171/123 45 67 89", "(020) 7946 0000"]
    spoken = ["five five five five five five five", "one-two-three-four-five-six-seven", "FIVE FIVE FIVE FIVE FIVE FIVE FIVE ext 2", "doſe ſeven seven seven six six six six six"]
    texts = [x for t in names + streets + mails + numbers + spoken for x in (f"Hm, {t} today.", f"my passport, {t}", t.upper(), t.replace("i", "ı"))] + ["Is Briero the one still living there"]
    scanner = Scanner(GIVEN)
    checked = [scanner.scan(t) for t in texts]
    seen = {s[0] for found in checked for s in found}
    assert seen == set(P.KINDS)
    monkeypatch.setattr(P, "hints", lambda text: dict.fromkeys(("EMAIL", "ADDRESS", "PHONE", "ID", "SPOKEN", "INTRO", "STILL"), True))
    assert [(t, x) for t, x in zip(texts, checked) if x != scanner.scan(t)] == []
    found = lambda t: {(k, t[a:b]) for k, a, b, _ in scanner.scan(t)}
    monkeypatch.undo()
    assert ("NAME", "Briero") in found("Je m'appelle Briero.") and ("NAME", "Briero") in found("My name's Briero.") and ("NAME", "Briero") in found("I saw M. Briero today")
    assert found("If I move to Velden m See, what then?") == set()
    assert ("ID", "AB123456C") in found("my id AB123456C") and ("EMAIL", "korven (arroba) tessarin.test") in found("mail korven (arroba) tessarin.test")
    assert ("PHONE", "five five five five five five five") in found("call five five five five five five five")


# 8 -----------------------------------------------------------------------------------------


def tricky_texts():
    r = random.Random(4)
    letters = "abcdefgh é漢🙂\n\t'’.,0123-_/"
    return ["", None, "aaaaaaaaa", "<|endoftext|> x", "  two  blanks\n\n\nend ", "I'll we've DON'T", "é ﬁ ​﻿", "x" * 5000, *["".join(r.choices(letters, k=r.randint(1, 80))) for _ in range(300)]]


def test_ids_equal_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = tricky_texts()
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in with_ids(df, "doc_id", "text").collect()}
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, x
        assert t.decode(got[i], skip_special_tokens=False) == (x or "")
    counts = {r.doc_id: r.n_tokens for r in with_token_count(df.select("doc_id", "text"), "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert with_ids(df.limit(0), "doc_id", "text").count() == 0


def test_encoder_forgets_and_goes_on(monkeypatch):
    import mnemosa.llm.tokens as K

    monkeypatch.setattr(K, "REMEMBERED", 3)
    e = Encoder.load(f"{TOKENIZERS}/byte_bpe_50k.json")
    first = e.encode_batch(["one two three four", "one"])
    assert e.encode_batch(["one two three four", "one"]) == first


# 9 -----------------------------------------------------------------------------------------

DOC = "doc_id bigint, source string, text string, n_tokens string, copies int"


def mixture(spark, docs, mix, **k):
    m = spark.createDataFrame(mix, "source string, weight double, max_repeats int")
    d = sized(spark.createDataFrame(docs, DOC), m)
    rows = mix_sources(d, plan(d, m, **k))
    return rows.collect(), {r.source: r for r in reached_shares(rows, m).collect()}


def test_mixture_reaches_weights_within_caps(spark):
    r = random.Random(5)
    docs = [(i, src, "word " * r.randint(5, 60), "x", 1) for i, src in enumerate(["Big-One"] * 900 + ["big_one "] * 100 + ["small"] * 40 + ["unnamed"] * 50 + [None] * 5)] + [(9001, "small", "", "x", 1), (9002, "small", None, "x", 1)]
    rows, shares = mixture(spark, docs, [("big_one", 0.5, 2), ("SMALL", 0.3, 4), ("absent", 0.2, 3), ("zero", 0.0, 1), (None, 0.1, 1)])
    assert shares["small"].reached_share == pytest.approx(0.375, abs=0.01) and shares["big_one"].reached_share == pytest.approx(0.625, abs=0.01)
    assert shares["absent"].reached_share == 0 and "zero" not in shares
    times = {}
    for x in rows:
        times.setdefault((x.source, x.doc_id), []).append(x.copy_no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in times.values())
    assert max(len(v) for (src, _), v in times.items() if src == "small") == 4 and sum(1 for src, _ in times if src == "small") == 40
    assert max(len(v) for (src, _), v in times.items() if src == "big_one") <= 2 and not {9001, 9002} & {d for _, d in times}
    again, _ = mixture(spark, docs, [("big_one", 0.5, 2), ("SMALL", 0.3, 4), ("absent", 0.2, 3), ("zero", 0.0, 1), (None, 0.1, 1)])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixture_with_given_size_and_of_nothing(spark):
    docs = [(i, "a", "one two three", "x", 1) for i in range(100)] + [(100 + i, "b", "one two three", "x", 1) for i in range(10)]
    rows, shares = mixture(spark, docs, [("a", 0.5, 1), ("b", 0.5, 3)], total_tokens=180)
    assert shares["b"].n_rows == 30 and 29 <= shares["a"].n_rows <= 31
    assert mixture(spark, [], [("a", 1.0, 1)])[0] == []
    assert mixture(spark, docs, [])[0] == []


# 10 ----------------------------------------------------------------------------------------

COMMON = [("en", w) for w in "the of and to a in is it was we they that have for not on with as at by this but from or an be so you he she i".split()] + [("de", w) for w in "ich nicht ist und der die das den wie du so".split()] + [("fr", "le"), ("fr", "la"), ("fr", "et"), ("fr", "de"), ("fr", "une"), ("es", "que"), ("es", "la"), ("es", "el"), ("es", "de"), ("en", None)]


def test_statistics(spark):
    rows = [(1, "The cat is here.\nNo end\n\n  Don't stop!\"", "x"), (2, None, "x"), (3, " \n", "x"), (4, "漢字 🙂🙂", "x"), (5, "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word_count string")
    got = {r.doc_id: r for r in statistics(df, ["the", "is", "don't", "no"]).collect()}
    assert (got[1].word_count, round(got[1].common_word_share, 4), round(got[1].punct_line_share, 4)) == (8, 0.5, 0.6667)
    assert got[1].mean_word_length == pytest.approx((3 + 3 + 2 + 4 + 2 + 3 + 5 + 4) / 8)
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0) == tuple(got[3])[1:]
    assert got[4].word_count == 1 and got[4].symbol_ratio == pytest.approx(0.4) and got[5].word_count == 100_000
    assert statistics(df.limit(0), []).count() == 0


def test_kinds_on_held_out_texts(spark, small):
    """Trained on the documents of the test data, right on the hand-checked holdout, which training doesn't see."""
    mid = small.replace("sf0.001", "sf0.01")
    docs, common = read_table(spark, mid, "documents"), read_table(spark, mid, "common_word")
    rows = [(i, t, "clash") for i, (_, t) in enumerate(HOLDOUT)] + [(9000, None, ""), (9001, "  \n ", "")]
    got = {x.doc_id: x for x in classify(spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), common, fitted_on=docs).collect()}
    wrong = [(got[i].kind, k, t) for i, (k, t) in enumerate(HOLDOUT) if got[i].kind != k]
    assert len(wrong) <= 0.15 * len(HOLDOUT), wrong
    assert 9000 not in got and 9001 not in got and all(0 < x.probability <= 1 for x in got.values())


def test_kinds_of_nothing(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    assert classify(spark.createDataFrame([], "doc_id bigint, text string"), common).count() == 0


def test_weak_labels_agree_with_hand_labels(spark):
    f = features(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HOLDOUT)], "doc_id bigint, text string"), sorted({w for _, w in COMMON if w}))
    said = [(weak_label(r.asDict()), HOLDOUT[r.doc_id][0]) for r in f.collect()]
    given = [(a, b) for a, b in said if a]
    assert len(given) >= 0.6 * len(said) and sum(a == b for a, b in given) >= 0.95 * len(given)


def test_boosting_learns_and_calibrates():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 4))
    y = ["a" if a > 0.3 else "b" if b > 0 else "c" for a, b, *_ in x]
    m = fit(x[:400], y[:400], rounds=25)
    p = m.probabilities(x[400:])
    assert np.mean([m.classes[i] == t for i, t in zip(p.argmax(1), y[400:])]) > 0.93
    m.calibrate(x[400:], y[400:])
    assert 0.25 <= m.temperature <= 8 and np.allclose(m.probabilities(x).sum(1), 1)
    json.dumps(m.classes)
