"""Byte-pair encoding of a whole table by replaying the merges over its distinct words.

Words are independent in byte-pair encoding, so each distinct word is encoded once per task, however often it occurs.
The new words of a batch are laid end to end as byte tokens; an inverted index from the token a pair would make to
the places of such pairs is opened in rank order, and a merge only touches the two neighbours of its place. A word's
tokens go to a pool; a text is then gathered from the pool by array arithmetic.

token_ids replays the words of each task's own rows: nothing is shuffled, and the vocabulary of the corpus is never in
one place. corpus_token_ids replays every different word of the corpus once, words dealt by hash, and joins the ids back,
which costs a shuffle of all words. Null and empty texts have the empty list.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the tokenizer parts a text into words; white space is Unicode's property, which is narrower than \s.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct words held per task; the pool starts over when full, which changes no result.
WORDS = 400_000
#: Parts of the places of one word in a join.
SALTS = 8
#: Rows encoded at a time.
ROWS = 512


def read_ranks(path: str) -> bytes:
    """The vocabulary file: one line per token, base64 and rank; under a megabyte, so it may go to every task."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    def __init__(self, vocabulary: bytes):
        import regex

        pairs = (line.split() for line in vocabulary.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # What two byte tokens make, -1 for nothing.
        self.made = np.full((256, 256), -1, dtype=np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.made[token[0], token[1]] = rank
        self.joined: dict[tuple[int, int], int] = {}
        self.words = regex.compile(PATTERN).findall
        self._restart()

    def _restart(self) -> None:
        self.at: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts: list[int] = []
        self.lengths: list[int] = []

    def _join(self, a: int, b: int) -> int:
        key = a, b
        rank = self.joined.get(key)
        if rank is None:
            rank = self.joined[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return rank

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words end to end, and how many each has."""
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        n = len(flat)
        owner = np.repeat(np.arange(len(raw)), sizes)
        if n == 0:
            return np.zeros(0, dtype=np.int32), sizes
        # The inverted index: rank of what a pair makes -> places of its left token.
        first = self.made[flat[:-1], flat[1:]]
        first[owner[:-1] != owner[1:]] = -1
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        ranks, cuts = np.unique(first[places], return_index=True)
        index: dict[int, list[int]] = {
            int(r): p.tolist() for r, p in zip(ranks, np.split(places, cuts[1:]), strict=True)
        } if len(places) else {}
        token = self.byte[flat].tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        ends = np.cumsum(sizes)
        for b, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            if e > b:
                left[b], right[e - 1] = -1, -1
        heap = sorted(index)
        join = self._join
        while heap:
            rank = heapq.heappop(heap)
            spots = index.pop(rank, None)
            if spots is None:
                continue
            spots.sort()  # the leftmost pair first, as in a run of one letter
            for p in spots:
                q = right[p]
                if q < 0 or token[p] < 0 or join(token[p], token[q]) != rank:
                    continue  # a neighbour has changed since
                token[p], token[q] = rank, -1
                after = right[p] = right[q]
                if after >= 0:
                    left[after] = p
                    made = join(rank, token[after])
                    if made >= 0:
                        if made not in index:
                            index[made] = []
                            heapq.heappush(heap, made)
                        index[made].append(p)
                before = left[p]
                if before >= 0:
                    made = join(token[before], rank)
                    if made >= 0:
                        if made not in index:
                            index[made] = []
                            heapq.heappush(heap, made)
                        index[made].append(before)
        done = np.array(token, dtype=np.int32)
        kept = done >= 0
        return done[kept], np.bincount(owner[kept], minlength=len(raw))

    def _learn(self, words: list[str]) -> None:
        tokens, sizes = self.replay(words)
        while self.used + len(tokens) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype=np.int32)])
        self.pool[self.used : self.used + len(tokens)] = tokens
        self.starts += (self.used + np.cumsum(sizes) - sizes).tolist()
        self.lengths += sizes.tolist()
        self.used += len(tokens)

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words end to end, and how many each text has."""
        if len(self.at) > WORDS:
            self._restart()
        at, new, numbers, counts = self.at, [], [], []
        for text in texts:
            words = self.words(text) if text else []
            for w in words:
                k = at.get(w)
                if k is None:
                    k = at[w] = len(at)
                    new.append(w)
                numbers.append(k)
            counts.append(len(words))
        if new:
            self._learn(new)
        return np.array(numbers, dtype=np.int64), np.array(counts, dtype=np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        numbers, words = self._numbered(texts)
        sizes = np.concatenate([[0], np.cumsum(np.array(self.lengths, dtype=np.int64)[numbers])])
        ends = np.cumsum(words)
        return sizes[ends] - sizes[ends - words]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        numbers, words = self._numbered(texts)
        sizes = np.array(self.lengths, dtype=np.int64)[numbers]
        starts = np.array(self.starts, dtype=np.int64)[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        total = int(ends[-1])
        values = self.pool[np.repeat(starts - ends[:-1], sizes) + np.arange(total)]
        offsets = ends[np.concatenate([[0], np.cumsum(words)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _mapped(df: DataFrame, key: str, text: str, tokenizer: str, ids: bool) -> DataFrame:
    kind = dict(df.dtypes)[key]
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                texts = part.column(1).to_pylist()
                made = encoder.encode(texts) if ids else pa.array(encoder.counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["k", "v"])

    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return src.mapInArrow(run, f"k {kind}, v {'array<int>' if ids else 'bigint'}").withColumnRenamed("k", key)


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """key, ids: the token ids of each text, without special tokens."""
    return _mapped(df, key, text, tokenizer, True).withColumnRenamed("v", "ids")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """key, n_tokens: how many tokens each text has."""
    return _mapped(df, key, text, tokenizer, False).withColumnRenamed("v", "n_tokens")


def corpus_token_ids(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The same as token_ids, each different word of the corpus replayed once."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                words = [find(t) if t else [] for t in part.column(1).to_pylist()]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                ends = np.cumsum(sizes)
                at = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
                rows = part.column(0).take(pa.array(np.repeat(np.arange(len(words)), sizes)))
                yield pa.RecordBatch.from_arrays([rows, pa.array(at.astype(np.int32)), pa.array([w for ws in words for w in ws], pa.string())], ["row", "at", "word"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            tokens, sizes = encoder.replay(b.column(0).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))], ["word", "ids"])

    # Keys may come twice, so rows have numbers of their own, which stay the same because they are written.
    src = cut(spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).withColumn("row", F.monotonically_increasing_id()))
    words = src.select("row", "t").mapInArrow(parted, "row bigint, at int, word string")
    # Words that a third of all places have meet in one task of the join unless copies are dealt out, too.
    salt = F.pmod(F.col("row"), F.lit(SALTS)).cast("int")
    known = words.select("word").distinct().mapInArrow(replayed, "word string, ids array<int>")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = words.withColumn("salt", salt).join(known, ["word", "salt"])
    lists = met.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    none = F.array().cast("array<int>")
    return src.select("k", "row").join(lists, "row", "left").select(F.col("k").alias(key), F.coalesce("ids", none).alias("ids"))
