"""The profile of texts against column expressions and plain counts, and kinds of documents checked by hand."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemosa.llm import profile as P
from mnemosa.llm import quality as Q
from mnemosa.sources.tables import read_table

# Documents of sf0.01 read and labelled by hand; none is used in training or calibration.
HAND = {
    "junk": (100, 222, 817, 941, 524, 827, 1137, 169, 1299, 12, 396, 882, 256, 168, 659, 1133, 1164, 1184, 1244, 643, 358),
    "table": (878, 385, 218, 317, 1330, 922, 308, 9, 492, 525, 386, 674, 744, 486, 51, 267),
    "list": (874, 1088, 715, 450, 233, 303, 1179, 8, 610, 948, 1467, 1068, 78, 556, 1003, 1451, 1185, 61, 1237, 721, 270, 1196),
    "prose": (947, 879, 316, 348, 483, 115, 228, 273, 1054, 1247, 135, 1439, 794, 203, 605, 422, 1409, 458, 877, 181, 549, 432, 821, 584),
}
TABLE = P.class_table()
COMMON = ["the", "is", "don't", "no"]


def test_kinds_of_documents_checked_by_hand(spark, small):
    mid = small.replace("sf0.001", "sf0.01")
    docs, common = read_table(spark, mid, "documents"), read_table(spark, mid, "common_word")
    got = {r.doc_id: r for r in Q.classify(docs, common).collect()}
    right = [got[i].kind == k for k, ids in HAND.items() for i in ids]
    assert np.mean(right) >= 0.97, [(i, k, got[i].kind) for k, ids in HAND.items() for i in ids if got[i].kind != k]
    weak = {r.doc_id: Q.weak_label(r.asDict()) for r in Q.features(docs, Q.common_words(common)).collect()}
    bare = np.mean([weak[i] == k for k, ids in HAND.items() for i in ids])
    assert np.mean(right) >= bare  # trees also decide where the rules abstain
    sure = [got[i].probability for ids in HAND.values() for i in ids]
    assert abs(np.mean(sure) - np.mean(right)) < 0.1  # probabilities mean what they say


def test_statistics_equal_column_expressions(spark, small):
    docs, common = read_table(spark, small, "documents"), Q.common_words(read_table(spark, small, "common_word"))
    want = {r.doc_id: r for r in Q.statistics(docs.selectExpr("doc_id", r"regexp_replace(text, '\r\n?|[\\x{2028}\\x{2029}\\x{85}]', '\n') AS text"), common).collect()}
    got = Q.features(docs, common).collect()
    assert len(got) > 50
    for r in got:
        for c in P.STATS:
            assert abs(r[c] - want[r.doc_id][c]) < 1e-9, (r.doc_id, c)


CHARS = st.text(alphabet="aAzZ019 \t\n\r-'’_|;,.!?…\"»)+=/%{}ÃÂâ€éßД漢🙂́ \x85\x9f ", max_size=60)
#: What each count means, as a pattern over the whole text.
PATTERNS = {
    "ends_a_word": re.compile(r'(?:[^\W_]|[)"»])[.!?…。！？](?=[ \t\n\x0b\x0c\r"»”)]|$)'),
    "mixed": re.compile(r"[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]|[^\W\d_][+/=%{}&_|][^\W_]"),
    "broken": re.compile("[ÃÂ][\x80-\xbf]|[\x80-\x84\x86-\x9f]|�|Ã|Â|â€"),
}


@settings(max_examples=150, deadline=None)
@given(st.lists(CHARS, min_size=1, max_size=5))
def test_profile_equals_plain_counts(texts):
    rows, seen = P.profile(texts, TABLE, P.common_numbers(COMMON))
    for t, row, shown in zip(texts, rows, seen):
        f = dict(zip((*P.STATS, *P.EXTRA), row))
        t = P.normal_lines(t)
        assert shown == any(not c.isspace() and c not in "\x1c\x1d\x1e\x1f" for c in t)
        words = re.findall(r"(?:[^\W_]|́)+(?:['’-](?:[^\W_]|́)+)*", t.lower())
        lines = [s for s in t.split("\n") if s.strip(P.SPACES)]
        n, chars = max(1, len(words)), max(1, len(t))
        assert (f["word_count"], f["lines"]) == (len(words), len(lines))
        assert abs(f["common_word_share"] - sum(w in COMMON for w in words) / n) < 1e-9
        for name, whole in (("ends_a_word", n if words else 0), ("mixed", n if words else 0), ("broken", chars)):
            want = len(PATTERNS[name].findall(t.rstrip("\n") + "\n" * (t != t.rstrip("\n")))) if name == "ends_a_word" else len(PATTERNS[name].findall(t))
            assert abs(f[name] - (want / whole if whole else 0)) < 1e-9, (name, t)
        assert abs(f["letters"] - sum(c.isalpha() for c in t) / chars) < 1e-9
        assert abs(f["marked"] * max(1, len(lines)) - sum(P.MARKED.match(s) is not None for s in lines)) < 1e-9


def test_lines():
    rows = ["a | b | c", "x\ty", "1;2;3", "a;b", "10,20,30", "town      km      pop", "Oslo    12", "+----+----+", "--- ---"]
    assert all(map(P.is_row, rows))
    assert not any(map(P.is_row, ["a | b", "plain words", "one; two; three", "I came, I saw, I won", "end  of line", "- item", "\t"]))
    assert P.is_short("one two") and not P.is_short("one two.") and not P.is_short("a b c d e f g") and not P.is_short("a\tb")


def test_long_text_and_pieces(monkeypatch):
    monkeypatch.setattr(P, "PIECE", 50)
    parts = list(P.pieces(["a" * 30, None, "b" * 30, "c" * 500, ""]))
    assert [len(p) for p in parts] == [2, 1, 1, 1] and sum(parts, []) == ["a" * 30, "", "b" * 30, "c" * 500, ""]
    rows, seen = P.profile(["word " * 200_000, ""], TABLE, P.common_numbers(["word"]))
    assert rows[0][0] == 200_000 and rows[0][4] == 1 and list(seen) == [True, False] and not rows[1].any()


def test_documents_without_a_kind_to_learn(spark):
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    got = Q.classify(spark.createDataFrame([(1, "Zq"), (2, None), (3, " ")], "doc_id bigint, text string"), common).collect()
    assert [r.doc_id for r in got] == [1] and got[0].kind in ("prose", "list", "table", "junk")
