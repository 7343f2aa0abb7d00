"""Problem 8: ids of a corpus by a public byte-level BPE vocabulary.

Each pre-token is merged by a priority queue of merge ranks over a doubly
linked list of symbols; entries made stale by an earlier merge are skipped when
they surface.  Ids of pre-tokens are kept per Python worker, as a corpus repeats
its words.  The rank file is read once on the driver and broadcast: it is
the file of one vocabulary (about 1 MB), whatever the corpus.

Defined results: null and empty texts have an empty list; lone surrogates
cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Place of the vocabulary files; a parameter of every function that reads one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens a worker keeps before it starts afresh.
CACHE_WORDS = 500_000


class BytePairEncoder:
    """Ranks of one vocabulary; a token's id is its rank."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.words = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        symbol = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            a, b = symbol[i], symbol[j]
            if not a or not b or right[i] != j or len(a) + len(b) != size:
                continue  # one of the two was merged since
            symbol[i], symbol[j] = a + b, b""
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if (r := ranks.get(symbol[i] + symbol[after])) is not None:
                    heapq.heappush(queue, (r, i, after, size + len(symbol[after])))
            before = left[i]
            if before >= 0 and (r := ranks.get(symbol[before] + symbol[i])) is not None:
                heapq.heappush(queue, (r, before, i, size + len(symbol[before])))
        return [ranks[s] for s in symbol if s]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and for empty text."""
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        for word in self.split(text):
            found = known.get(word)
            if found is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                found = known[word] = self.merge(word.encode())
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by concatenating their vocabulary strings."""
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _encoder(rank_file: bytes, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(rank_file, pattern)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the list of ids of each text."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = _encoder(shared.value, pattern).encode
        return texts.map(encode)

    return df.withColumn(out, ids(F.col(text)))


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of each list of ids; null lists give null."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        decode = _encoder(shared.value, PATTERN).decode
        return lists.map(lambda x: None if x is None else decode(x))

    return df.withColumn(out, text(F.col(ids)))


def encode_table(spark: SparkSession, documents: DataFrame, **options) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode_texts(documents.select("doc_id", "text"), **options).select("doc_id", "ids")
