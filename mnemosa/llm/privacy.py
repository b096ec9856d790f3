"""Personal information in free text: spans found by labelers that vote, and placeholders.

Patterns propose spans. For every span the labelers vote (+ for, - against, 0 abstain):
shape, gazetteer, lexicon, words before and after. Spans with the same votes form one
pattern; expectation-maximisation over the counts of all patterns of the corpus estimates
how reliable each labeler is and how likely a pattern is an item. A logistic classifier over
votes and pairs of votes, fitted to those probabilities, gives the final decision.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosa.llm import privacy_rules as R
from mnemosa.session import materialize

KINDS = ("EMAIL", "ADDRESS", "PHONE", "ID", "NAME")
#: Beyond so many learned names each text gets those it contains by a join, not all by broadcast.
LEXICON_MOST = 200_000
#: Most given names: the list goes to every task, so a longer one is refused, not cut.
GIVEN_MOST = 1_000_000
#: A family name is learned from so many different texts at least.
LEXICON_LEAST = 2
#: A word is common if this share of the different texts has it in lower case.
COMMON_SHARE = 0.001

#: What a learned name was seen as, in the lexicon: a family name, or one after a title or an introduction.
_PARTS = ("f", "g")

_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters that re.I takes for ASCII ones but str.lower leaves.
_FOLDED = str.maketrans("İıſ", "iis")


def _before(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[^\w])(?:{words})[\s:.,;(\"<#'’\-]*(?:(?:is|was|are|no|nr|est|es|ist|lautet|le|la|on|at|me|the|number|under|unter|:)[\s:.(]*){{0,3}}$", re.I)


_LEFT = {
    "NAME": re.compile(rf"(?:^|[^\w])(?:{R.NAME_LEFT})[\s]*$", re.I),
    "EMAIL": re.compile(rf"\b(?:{R.MAIL_LEFT})\b[^.!?\n]{{0,40}}$", re.I),
    "PHONE": _before(R.PHONE_LEFT),
    "ID": _before(R.ID_LEFT),
    "ADDRESS": re.compile(rf"(?:^|[^\w])(?:{R.ADDRESS_LEFT})[\s:]*$|\n$|^$", re.I),
}
_LEAD = re.compile(rf"(?:^|[^\w])(?:{R.NAME_INTRO})\s*(?:(?:{R.TITLES})\.? )?$", re.I)
_TITLE = re.compile(rf"(?:^|[^\w])(?:{R.TITLES})\.?\s$", re.I)
_NAME_RIGHT = re.compile(rf"\s(?:{R.NAME_RIGHT})(?![^\W\d_])", re.I)
_NEXT = re.compile(r" ([^\W\d_]+)")
_NAME_END = re.compile(rf"\s(?:{R.NAME_END})(?![^\W\d_])|\s?[^\w\s]|$|\n", re.I)
_ID_RIGHT = re.compile(rf"[\s,]*(?:{R.ID_RIGHT})", re.I)
_AGAINST = re.compile(rf"(?:^|[^\w])(?:{R.NOT_PERSONAL})[\s:#.-]*$", re.I)
_LIST_LEFT = re.compile(r"(?:and|und|et|y|e|&)\s$", re.I)
_INTRO = re.compile(rf"(?:^|[^\w])(?:(?:{R.TITLES})\.? |(?:{R.NAME_INTRO})\s*(?:(?:{R.TITLES})\.? )?)(?-i:([A-ZÀ-ÞĀ-Ž][^\W\d_]*(?:[-'’][^\W\d_]+)*))(?!['’]s)", re.I)
_SURNAME = re.compile(rf" ((?:[^\W\d_]\. )?(?:{R.PARTICLES} )?(?:mc |d['’])?[^\W\d_]+(?:[-'’][^\W\d_]+)*)(\.?)", re.I)
_INVERTED = re.compile(rf"(?<![\w.])((?:{R.PARTICLES} )?[^\W\d_]+(?:[-'’][^\W\d_]+)*), $", re.I)
_FORENAME = re.compile(rf"(?<![^\W\d_])(?:([^\W\d_]\.|[^\W\d_]+(?:[-'’][^\W\d_]+)*) )?((?:[^\W\d_]\. )?(?:{R.PARTICLES} |mc )?)$", re.I)
_AHEAD = re.compile(r", ([^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_INTRO_END = re.compile(r"(?:best|regards|cheers|thx|thanks|grüße|cordialement|saludos|saludo|atentamente|hi|hello|hey), $", re.I)
_DIGIT = re.compile(r"\d")
_DATE = re.compile(r"(?:19|20)\d\d[-./ ]?[01]\d[-./ ]?[0-3]\d\b.*")


def hints(text: str) -> dict[str, bool]:
    """Which patterns can match in the text at all. Each condition holds wherever its pattern matches."""
    low = (text if text.isascii() else text.translate(_FOLDED)).lower()
    listed = _WORD.findall(low)
    words = set(listed)
    digits = len(_DIGIT.findall(text))
    return {
        "EMAIL": "@" in text or not words.isdisjoint(R.DOT_WORDS) or not words.isdisjoint(R.AT_WORDS) and any(b in text for b in "([{"),
        "ADDRESS": digits > 0 and (not words.isdisjoint(R.STREET_WORDS) or any(p in low for p in R.STREET_PARTS) or any(w.endswith(R.STREET_ENDINGS) for w in words)),
        "PHONE": digits >= 9,
        "ID": digits >= 5,
        "SPOKEN": not words.isdisjoint(R.NUMBER_WORDS) and sum(w in R.NUMBER_WORDS for w in listed) >= 7,
        "INTRO": not words.isdisjoint(R.TITLE_WORDS) or any(p in low for p in R.INTRO_PARTS),
    }


class Scanner:
    """Finds candidate spans and their votes in a text. Plain data, so that it can be sent to workers."""

    def __init__(self, given: Iterable[str], family: Iterable[str] = (), common: Iterable[str] = (), firsts: Iterable[str] = ()):
        self.given = frozenset(g.lower() for g in given)
        self.given_words = frozenset(w for g in self.given for w in _TOKEN.findall(g))
        self.family, self.firsts = frozenset(family), frozenset(firsts)
        self.common = frozenset(common) - self.given
        self.stop = R.STOP | R.INTRO_WORDS | self.common - self.family - self.firsts
        self.seeds = self.given_words | self.family | self.firsts

    def within(self, known: Iterable[str]) -> Scanner:
        """This scanner with the names `known` (each with its part in _PARTS before it); for one text those it contains do for the whole lexicon."""
        if not known:
            return self
        other = copy.copy(self)
        other.family, other.firsts = (frozenset(k[1:] for k in known if k[0] == part) for part in _PARTS)
        other.seeds = self.given_words | other.family | other.firsts
        if not (other.family | other.firsts).isdisjoint(self.common):
            other.stop = R.STOP | R.INTRO_WORDS | self.common - other.family - other.firsts
        return other

    # names -----------------------------------------------------------------------------

    def _surname(self, text: str, at: int, model: str, eager: bool) -> tuple[int, bool]:
        """Where a family name that begins at `at` after one blank ends (or `at`), and if the lexicon has it."""
        m = _SURNAME.match(text, at)
        if not m:
            return at, False
        word = m.group(1)
        last = word.split(" ")[-1]
        low = last.lower()
        if low in self.family:
            return m.end(1), True
        if len(last) == 1:
            if m.group(2) and last.isupper():
                more = self._surname(text, m.end(), model, eager)
                return more if more[0] > m.end() else (m.end(), True)
            return at, False
        if low in self.stop or " " in word and not word[:2].endswith(".") and low == word.lower():
            return at, False
        if word.split(" ")[0].lower() in self.stop and not re.match(rf"{R.PARTICLES} |d['’]", word, re.I):
            return at, False
        first = word[0] if re.match(rf"{R.PARTICLES} |d['’]", word, re.I) is None else last.split("'")[-1].split("’")[-1][:1]
        if first.isupper() and model[0].isupper() and not (last.isupper() and not model.isupper()):
            return m.end(1), False
        if eager and model[0].islower() and last.islower() and len(last) > 3 and (_NAME_RIGHT.match(text, m.end(1)) or _NAME_END.match(text, m.end(1))):
            return m.end(1), False
        return at, False

    def _name_at(self, text: str, start: int, end: int) -> tuple[int, int, bool]:
        """The whole name around the given name text[start:end]: start, end, has a known family name."""
        model = text[start:end]
        left = text[max(0, start - 45) : start]
        stop, known = self._surname(text, end, model, model[0].islower() and bool(_TITLE.search(left) or _LEFT["NAME"].search(left)))
        if stop > end:
            return start, stop, known
        m = _INVERTED.search(left)
        if m:
            word = m.group(1)
            last = word.split(" ")[-1]
            low = last.lower()
            known = low in self.family
            if known or low not in self.stop and low not in self.given and last[0].isupper() and model[0].isupper() and len(last) > 3 and last.isupper() == model.isupper() and not _INTRO_END.search(left):
                return start - 2 - len(word), end, known
        return start, end, False

    def _names(self, text: str, can: dict[str, bool], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        found: dict[tuple[int, int], tuple[bool, bool]] = {}
        seen: dict[tuple[int, int], bool] = {}
        if not self.seeds.isdisjoint(map(str.lower, _TOKEN.findall(text))):
            for m in _TOKEN.finditer(text):
                word, s, e = m.group(0).lower(), m.start(), m.end()
                first = word in self.given or word in self.firsts and word not in self.family and m.group(0)[0].isupper()
                if not first and word not in self.family:
                    continue
                if any(a < e and s < b for a, b in taken) or text[e : e + 1].isdigit() or text[e : e + 1] in ("@", "_"):
                    continue
                if first:
                    s, e, known = self._name_at(text, s, e)
                    found[s, e] = (word in self.given, known)
                    seen[s, e] = word in self.firsts
                    continue
                back = _FORENAME.search(text[max(0, s - 45) : s])
                if back:
                    s -= len(back.group(2))
                    first = back.group(1)
                    if first and (len(first) == 2 and first[1] == "." or len(first) > 2 and first.lower() not in self.stop and not re.fullmatch(R.TITLES, first, re.I) and first[0].isupper() == m.group(0)[0].isupper()):
                        s -= len(first) + 1
                        found.setdefault((s, e), (False, True))
                        continue
                ahead = _AHEAD.match(text, e)
                if ahead and ahead.group(1)[0].isupper() == m.group(0)[0].isupper() and ahead.group(1).lower() not in self.stop:
                    e = ahead.end(1)
                found.setdefault((s, e), (False, True))
        intros = []
        if can["INTRO"]:
            intros += [m.span(1) for m in _INTRO.finditer(text)]
        for s, e in intros:
            if text[s:e].lower() in self.stop or text[max(0, s - 3) : s] == " m " or any(a <= s < b for a, b in [*found, *taken]):
                continue
            if e - s == 1:
                stop, known = self._surname(text, e + 1, text[s:e], False) if text[e : e + 1] == "." else (e, False)
                if stop > e + 1:
                    found.setdefault((s, stop), (False, known))
                continue
            if text[e : e + 1] == "@" or text[e : e + 1].isdigit():
                continue
            s, stop, known = self._name_at(text, s, e)
            found.setdefault((s, stop), (False, known))
        spans: list[tuple[int, int, str]] = []
        last = -1
        for (s, e), (given, known) in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
            if s < last:
                continue
            last = e
            left, name = text[max(0, s - 45) : s], text[s:e]
            parts = len(name.split(" "))
            title = bool(_TITLE.search(left))
            lead = bool(_LEAD.search(left))
            intro = title or bool(_LEFT["NAME"].search(left)) or bool(_LIST_LEFT.search(left) and spans) or bool(s == 0 and parts > 1)
            intro = intro or bool(_NAME_RIGHT.match(text, e) and re.search(r"(?:^|[.!?…]\s|\n)$", left))
            ahead = _NEXT.match(text, e)
            after = "+" if _NAME_RIGHT.match(text, e) else "-" if ahead and ahead.group(1)[0].islower() and ahead.group(1).lower() not in R.STOP else "0"
            shape = "-" if name[0].islower() else "+" if parts > 1 else "0"
            votes = ("+" if given else "0", "+" if seen.get((s, e)) else "0", "+" if known or seen.get((s, e)) else "0" if parts > 1 else "-", "+" if title else "0", "+" if lead else "0", "+" if intro else "0", after, shape)
            spans.append((s, e, "".join(votes)))
        return spans

    def learn(self, texts: Iterable[str]) -> tuple[Counter, Counter, Counter]:
        """With the number of texts: words that stand as a capitalised family name beside a given name, words that stand as a name after a title or what introduces one, and words in lower case."""
        family: Counter = Counter()
        firsts: Counter = Counter()
        common: Counter = Counter()
        for text in texts:
            words = set(_TOKEN.findall(text))
            common.update(filter(str.islower, words))
            mine = set()
            if not self.given_words.isdisjoint(map(str.lower, words)):
                for m in _TOKEN.finditer(text):
                    if m.group(0).lower() in self.given and m.group(0).istitle():
                        s, e, _ = self._name_at(text, m.start(), m.end())
                        rest = text[m.end() : e] if e > m.end() else text[s : m.start()].rstrip(", ")
                        word = rest.split(" ")[-1]
                        if len(word) > 3 and (word[0].isupper() and not word.isupper() or re.match(r"d['’]", word)):
                            mine.add(word.lower())
            family.update(mine)
            if hints(text)["INTRO"]:
                told = {m.group(1) for m in _INTRO.finditer(text)}
                firsts.update({w.lower() for w in told if len(w) > 2 and not w.isupper()} - self.given - self.stop)
        return family, firsts, common

    # all kinds -------------------------------------------------------------------------

    def scan(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, end, votes) of every candidate."""
        if not text:
            return []
        spans: list[tuple[str, int, int, str]] = []
        low = text.lower()
        can = hints(text)
        if can["EMAIL"]:
            for m in R.EMAIL.finditer(text):
                item = m.group(0)
                ending = re.split(r"[^\w]+", item)[-1].lower()
                plain = "+" if re.fullmatch(r"[\w.+-]+@[\w-]+(\.[\w-]+)+", item) else "0"
                valid = "-" if ending in R.FILE_ENDINGS or not ending.isalpha() or len(ending) < 2 else "+"
                left = "+" if _LEFT["EMAIL"].search(text[max(0, m.start() - 60) : m.start()]) else "0"
                spans.append(("EMAIL", m.start(), m.end(), plain + valid + left))
        if can["ADDRESS"]:
            for m in R.ADDRESS.finditer(text):
                s, e = m.start(), m.end()
                item = text[s:e].rstrip(" ,.") if not re.search(r"\b(?:og|rd|st|ave|str)\.$", text[s:e], re.I) else text[s:e].rstrip(" ,")
                if re.search(r"\b(?:rd|st|ave|og)\.$", item, re.I):
                    item = item[:-1]
                inner = re.findall(r"[^\W\d_]+", item)
                while len(inner) > 1 and "box" in low and item.endswith(inner[-1]) and inner[-1].lower() in self.stop:
                    item = item[: -len(inner.pop())].rstrip(" ,")
                number = "+" if re.search(r"\d", item) else "-"
                named = "+" if sum(w[0].isupper() for w in inner if len(w) > 2) >= 1 else "0"
                odd = "-" if any(w.lower() in R.STOP - {"st", "rd", "ave", "row", "lane", "road", "court", "street", "stop", "am", "de", "la", "des", "du", "le", "les", "der", "an", "im", "c", "no", "d", "del", "los", "las", "blue"} for w in inner) or re.search(r"\d[:.]\d", item) else "0"
                place = "+" if re.search(r"\d{5}|\b(?:apt|appt|flat|og)\b|º", item[3:], re.I) else "0"
                left = "+" if _LEFT["ADDRESS"].search(text[max(0, s - 30) : s]) else "0"
                spans.append(("ADDRESS", s, s + len(item), number + named + odd + place + left))
        for kind, pattern in (("PHONE", R.PHONE), ("ID", R.ID)):
            if can[kind]:
                for m in pattern.finditer(text):
                    item, s, e = m.group(0), m.start(), m.end()
                    bare = sum(c.isdigit() for c in item)
                    if kind == "PHONE" and not 9 <= sum(c.isdigit() for c in re.split(r"(?i)\s*(?:ext|x|dur|dw|poste|int|anexo)", item)[0]) <= 15:
                        continue
                    left = text[max(0, s - 40) : s]
                    mine = "+" if _LEFT[kind].search(left) else "0"
                    other = "-" if _LEFT["ID" if kind == "PHONE" else "PHONE"].search(left) else "0"
                    if kind == "ID" and _ID_RIGHT.match(text, e):
                        mine = "+"
                    against = "-" if _AGAINST.search(left) or _DATE.fullmatch(item) else "0"
                    if kind == "PHONE":
                        shape = "+" if re.match(r"\+|00|\(|0|1[ .-]", item) or re.fullmatch(r"[2-9]\d{2}[ .-]?\d{3}[ .-]?\d{4}.*", item) else "0"
                    else:
                        shape = "+" if re.search(r"[a-z]", item, re.I) or re.fullmatch(r"\d{3}[ -]\d{2}[ -]\d{4}|\d{2}[ -]\d{4}[ -]\d{4}", item) or bare in (13, 15) or re.fullmatch(r"\d{2} \d{2,3} \d{3} \d{3,4}|\d{9}|\d{11}", item) else "0"
                    spans.append((kind, s, e, shape + mine + other + against))
        if can["SPOKEN"]:
            for m in R.SPOKEN.finditer(text):
                left = text[max(0, m.start() - 40) : m.start()]
                spans.append(("PHONE", m.start(), m.end(), "+" + ("+" if _LEFT["PHONE"].search(left) else "0") + "0" + ("-" if _AGAINST.search(left) else "0")))
        spans += [("NAME", *n) for n in self._names(text, can, [(s, e) for k, s, e, _ in spans if k in ("EMAIL", "ADDRESS")])]
        return spans


# reliabilities and classifier ------------------------------------------------------------


def estimate(counts: dict[tuple[str, str], int], rounds: int = 60) -> dict[tuple[str, str], float]:
    """The probability that a span with these votes is an item, by kind.

    Two classes, votes independent given the class; the prior of each labeler says only that
    a vote is right more often than not. A span without a vote against it and with at least
    two for it starts as an item.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in KINDS:
        votes = [(v, n) for (k, v), n in counts.items() if k == kind]
        if not votes:
            continue
        x = np.array([[("-0+").index(c) for c in v] for v, _ in votes])
        n = np.array([float(c) for _, c in votes])
        score = (x - 1).sum(1)
        p = 1 / (1 + np.exp(-2.0 * (score - 0.5)))
        prior = np.array([[1.0, 2.0, 4.0], [4.0, 2.0, 1.0]]) * 2  # item, other: against, abstain, for
        for _ in range(rounds):
            w = np.stack([p * n, (1 - p) * n])
            rate = np.stack([[np.bincount(x[:, j], weights=w[c], minlength=3) + prior[c] * max(1.0, 0.02 * n.sum()) for j in range(x.shape[1])] for c in (0, 1)])
            rate /= rate.sum(2, keepdims=True)
            share = np.clip((p * n).sum() / n.sum(), 0.05, 0.95)
            logit = np.log(share / (1 - share)) + sum(np.log(rate[0, j, x[:, j]] / rate[1, j, x[:, j]]) for j in range(x.shape[1]))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out.update({(kind, v): q for (v, _), q in zip(votes, _classify(x, n, p))})
    return out


def _classify(x: np.ndarray, n: np.ndarray, p: np.ndarray, steps: int = 400) -> np.ndarray:
    """A logistic classifier over votes and pairs of votes, fitted to soft labels."""
    one = np.concatenate([(x == 0), (x == 2)], axis=1).astype(float)
    i, j = np.triu_indices(one.shape[1], 1)
    f = np.concatenate([np.ones((len(x), 1)), one, one[:, i] * one[:, j]], axis=1)
    w, weight = np.zeros(f.shape[1]), np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-f @ w))
        h = (f * (weight * q * (1 - q))[:, None]).T @ f + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, f.T @ (weight * (q - p)) + 1e-4 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-f @ w))


def resolve(spans: list[tuple[str, int, int, str]], scores: dict[tuple[str, str], float]) -> list[tuple[str, int, int]]:
    """The spans that are items; of overlapping ones the longest, then the likeliest."""
    kept = [(k, s, e, scores.get((k, v), 0.0)) for k, s, e, v in spans]
    rank = {k: i for i, k in enumerate(KINDS)}
    kept = sorted((x for x in kept if x[3] >= 0.5), key=lambda x: (x[1] - x[2] if x[0] in ("EMAIL", "ADDRESS", "NAME") else x[1] - x[2], -x[3], rank[x[0]]))
    taken: list[tuple[str, int, int]] = []
    for k, s, e, _ in kept:
        if all(e <= a or b <= s for _, a, b in taken):
            taken.append((k, s, e))
    return sorted(taken, key=lambda x: x[1])


# on tables -------------------------------------------------------------------------------

_FOUND = "field string, uuid string, text string, spans array<struct<kind:string,s:int,e:int,votes:string>>"


def build_scanner(texts: DataFrame, given_names: DataFrame) -> tuple[Scanner, DataFrame | None]:
    """A scanner with the lexicon learned from all different `texts` (text), and the learned names (part, word) if they are too many for it.

    Common words are in so large a share of the texts that their number is bounded by
    1 / COMMON_SHARE times the mean number of words of a text.
    """
    names = [r.name for r in given_names.filter("name IS NOT NULL").select("name").distinct().limit(GIVEN_MOST + 1).collect()]
    if len(names) > GIVEN_MOST:
        raise ValueError(f"more than {GIVEN_MOST} given names")
    counted = texts.select("text").distinct().mapInArrow(_learner(Scanner(names)), "word string, family bigint, firsts bigint, common bigint")
    sums = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("family", "firsts", "common")])
    hits = materialize(sums.filter(F.greatest("family", "firsts", "common") >= LEXICON_LEAST))
    n = sum(r.common for r in hits.filter("word = ''").collect())
    common = [r.word for r in hits.filter((F.col("word") != "") & (F.col("common") >= max(LEXICON_LEAST, COMMON_SHARE * n))).collect()]
    parts = [hits.filter((F.col(c) >= LEXICON_LEAST) & (F.col(c) > F.col("common") / 4)).select(F.concat(F.lit(p), "word").alias("part"), "word") for c, p in zip(("family", "firsts"), _PARTS)]
    lexicon = parts[0].unionByName(parts[1])
    most = [r.part for r in lexicon.limit(LEXICON_MOST + 1).collect()]
    if len(most) > LEXICON_MOST:
        return Scanner(names, (), common), lexicon
    return Scanner(names, [w[1:] for w in most if w[0] == _PARTS[0]], common, [w[1:] for w in most if w[0] == _PARTS[1]]), None


def with_known(texts: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """`texts` with `known`, the learned names each contains, where they are too many for the scanner; else as it is."""
    if lexicon is None:
        return texts
    words = texts.filter("text IS NOT NULL").select(F.md5("text").alias("_id"), "text").distinct().mapInArrow(_worder, "_id string, word string")
    known = words.join(lexicon, "word").groupBy("_id").agg(F.collect_set("part").alias("known"))
    return texts.withColumn("_id", F.md5("text")).join(known, "_id", "left").drop("_id")


def _worder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, words = [], []
        for i, text in zip(b.column("_id").to_pylist(), b.column("text").to_pylist()):
            mine = {w.lower() for w in _TOKEN.findall(text)}
            ids += [i] * len(mine)
            words += mine
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.string())], names=["_id", "word"])


def _learner(scanner: Scanner):
    """Counts of words by batch; the word '' counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            family, firsts, common = scanner.learn(b.column("text").to_pylist())
            common[""] = b.num_rows
            words = list(family.keys() | firsts.keys() | common.keys())
            counts = [pa.array([c[w] for w in words], pa.int64()) for c in (family, firsts, common)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *counts], names=["word", "family", "firsts", "common"])

    return run


def _scanned(b: pa.RecordBatch, scanner: Scanner) -> Iterator[tuple[str, list[tuple[str, int, int, str]]]]:
    """Each text of the batch with its candidates."""
    texts = b.column("text").to_pylist()
    known = b.column("known").to_pylist() if "known" in b.schema.names else [None] * len(texts)
    for text, mine in zip(texts, known):
        yield text, (scanner.within(mine) if mine else scanner).scan(text)


def _finder(scanner, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, spans = [], []
            for i, (_, found) in enumerate(_scanned(b, scanner.value)):
                if found or every:
                    at.append(i)
                    spans.append([{"kind": k, "s": s, "e": e, "votes": v} for k, s, e, v in found])
            if at:
                kept = b.take(pa.array(at))
                kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("votes", pa.string())]))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("field", "uuid", "text")), pa.array(spans, kind)], names=["field", "uuid", "text", "spans"])

    return run


def _chooser(scores):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for field, uuid, text, spans in zip(*(b.column(c).to_pylist() for c in ("field", "uuid", "text", "spans"))):
                for kind, s, e in resolve([(x["kind"], x["s"], x["e"], x["votes"]) for x in spans], scores):
                    for col, x in zip(out, (field, uuid, kind, text[s:e])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["field", "uuid", "kind", "found_text"])

    return run


def candidates(texts: DataFrame, scanner: Scanner, every: bool = False) -> DataFrame:
    """field, uuid, text, spans of the texts (field, uuid, text) that have candidates, or of all; materialised."""
    shared = texts.sparkSession.sparkContext.broadcast(scanner)
    return materialize(texts.mapInArrow(_finder(shared, every), _FOUND))


def reliabilities(found: DataFrame) -> dict[tuple[str, str], float]:
    """Scores of all vote patterns, from their counts over the whole corpus (a few hundred rows)."""
    counts = found.select(F.inline("spans")).groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate({(r.kind, r.votes): r.n for r in counts})


def find_personal(texts: DataFrame, given_names: DataFrame) -> DataFrame:
    """field, uuid, kind, found_text: each different item of each record, as written.

    `texts` has field, uuid, text. Null and empty texts have no items; texts of any length
    are read whole. Shuffles: the distinct texts the lexicon is learned from, its counts,
    and the final distinct over the items; the texts once more where the lexicon must be joined.
    """
    texts = texts.filter("text IS NOT NULL AND text <> ''")
    scanner, lexicon = build_scanner(texts, given_names)
    found = candidates(with_known(texts, lexicon), scanner)
    return found.mapInArrow(_chooser(reliabilities(found)), "field string, uuid string, kind string, found_text string").distinct()


def redact(texts: DataFrame, given_names: DataFrame) -> DataFrame:
    """field, uuid, text with each item replaced by its placeholder; other text unchanged, null stays null."""
    usable = texts.filter("text IS NOT NULL AND text <> ''")
    scanner, lexicon = build_scanner(usable, given_names)
    found = candidates(with_known(texts.select("field", "uuid", "text"), lexicon), scanner, True)  # every text is scanned once
    scores = reliabilities(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            out = [t and replace(t, resolve([(x["kind"], x["s"], x["e"], x["votes"]) for x in mine], scores)) for t, mine in zip(b.column("text").to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("uuid"), pa.array(out, pa.string())], names=["field", "uuid", "text"])

    return found.mapInArrow(run, "field string, uuid string, text string")


def replace(text: str, items: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in items:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])
