"""Token ids of whole texts by a public byte-level BPE vocabulary.

The words of a batch that are new are merged together: an index maps each pair of adjacent
symbols to all its positions in the batch, the ranks of the pairs at hand are applied in
ascending order, and each merge updates the lists of the two pairs it makes. As words are
independent, this gives each word what merging it alone would give.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files lie on the driver; workers get them by broadcast.
TOKENIZERS = "/opt/tokenizers"
#: Words a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 1_000_000

# Fixed value: how the vocabulary's texts were cut into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Encoder:
    """Byte-level BPE from a vocabulary file's vocab and merges."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]]):
        letters = byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        self.rules = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.by_rank = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Encoder:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])

    def encode_words(self, words: Sequence[str]) -> list[tuple[int, ...]]:
        """The ids of each word, all words merged at once."""
        symbols: list[int] = []
        ends: list[int] = []
        for word in words:
            symbols += [self.byte_ids[b] for b in word.encode("utf-8", "surrogatepass")]
            ends.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = 0
        for end in ends:
            if end > start:
                after[end - 1], before[start] = n, -1
                start = end
        places: dict[int, list[int]] = {}
        rules = self.rules
        for i in range(n):
            j = after[i]
            if j < n and (rule := rules.get((symbols[i], symbols[j]))):
                places.setdefault(rule[0], []).append(i)
        ranks = list(places)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            left, right, made = self.by_rank[rank]
            spots = places.pop(rank)
            spots.sort()
            for i in spots:
                if symbols[i] != left or (j := after[i]) >= n or symbols[j] != right:
                    continue
                k = after[j]
                symbols[i], symbols[j], after[i] = made, -1, k
                if k < n:
                    before[k] = i
                    if rule := rules.get((made, symbols[k])):
                        if rule[0] not in places:
                            places[rule[0]] = []
                            heapq.heappush(ranks, rule[0])
                        places[rule[0]].append(i)
                h = before[i]
                if h >= 0 and (rule := rules.get((symbols[h], made))):
                    if rule[0] not in places:
                        places[rule[0]] = []
                        heapq.heappush(ranks, rule[0])
                    places[rule[0]].append(h)
        out, start = [], 0
        for end in ends:
            out.append(tuple(s for s in symbols[start:end] if s >= 0))
            start = end
        return out

    def encode_batch(self, texts: Sequence[str | None]) -> list[list[tuple[int, ...]]]:
        """Of each text its words' ids, in order; null and empty texts have none."""
        cut = regex.compile(WORDS).findall
        split = [cut(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, self.encode_words(new)))
        return [[known[w] for w in words] for words in split]


def shared_encoder(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A broadcast encoder; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(Encoder.load(f"{folder}/{vocabulary}.json"))


def with_ids(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids: the token ids of every text, without special tokens; empty for an empty or null text."""
    encoder = shared_encoder(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [list(chain.from_iterable(words)) for words in encoder.value.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def with_token_count(df: DataFrame, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """`df` without `text` and with n_tokens, the number of its ids."""
    encoder = shared_encoder(df.sparkSession, vocabulary, folder)
    rest = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(map(len, words)) for words in encoder.value.encode_batch(b.column(len(rest)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    return df.select(*rest, text).mapInArrow(run, f"{schema}, n_tokens bigint")
