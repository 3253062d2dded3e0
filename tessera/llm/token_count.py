"""Token counts by a longest-match automaton over a given vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose counts a worker remembers.
REMEMBERED = 500_000


def read_vocabulary(spark: SparkSession, path: str) -> tuple[bytes, ...]:
    """Tokens of a rank file (base64 token and rank per line), read by Spark from any store it knows."""
    uri = path if "://" in path else f"file://{path}"
    lines = spark.read.text(uri).where("value <> ''")
    return tuple(base64.b64decode(r[0].split(" ")[0]) for r in lines.collect())


class LongestMatch:
    """Trie of the tokens with failure links and popped-token counts.

    At node v, with string s, ``pops[v]`` is how many tokens greedy longest match takes off the
    front of s when no token goes on, and ``fail[v]`` the node of what is left, so each byte is
    read once and pieces are never built. The tokens must hold every single byte that occurs; a
    word with another byte counts as one token (unknown).
    """

    def __init__(self, tokens: tuple[bytes, ...]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for t in tokens:
            v = 0
            for b in t:
                if b not in edges[v]:
                    edges[v][b] = len(edges)
                    edges.append({})
                    final.append(False)
                v = edges[v][b]
            final[v] = bool(t)
        fail, pops = [-1] * len(edges), [0] * len(edges)
        queue = list(edges[0].items())
        parents = {v: 0 for _, v in queue}
        for b, v in queue:
            if final[v]:
                fail[v], pops[v] = 0, 1
            else:
                z, n = fail[parents[v]], pops[parents[v]]
                while z >= 0 and b not in edges[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = edges[z][b], n
            for c, w in edges[v].items():
                parents[w] = v
                queue.append((c, w))
        self.edges, self.fail, self.pops = edges, fail, pops
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of a word by greedy longest match; 1 if it can't be split."""
        edges, fail, pops = self.edges, self.fail, self.pops
        v = n = 0
        for b in word:
            while b not in edges[v]:
                n += pops[v]
                v = fail[v]
                if v < 0 or (v == 0 and b not in edges[0]):
                    return 1
            v = edges[v][b]
        while v > 0:
            n += pops[v]
            v = fail[v]
        return n if v == 0 else 1

    def total(self, words: list[bytes], mark: bytes) -> int:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        n = 0
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = self.count(mark + w)
            n += k
        return n


@lru_cache(maxsize=2)
def automaton(tokens: tuple[bytes, ...]) -> LongestMatch:
    """Built once per Python worker."""
    return LongestMatch(tokens)


COUNTS = StructType().add("n_words", LongType()).add("n_tokens", LongType())


def token_counts(text: Column, tokens: tuple[bytes, ...], mark: bytes = b" ") -> Column:
    """Struct (n_words, n_tokens) of whole texts: words between ASCII white space, each counted with
    ``mark`` before it (the vocabulary's sign of a word's beginning). Null and empty texts: 0, 0.

    A column function: rows stay where they are, repeated ones are counted alike, an empty table gives none,
    and no other column matters. Texts may be of any length; a text's words are held while it is counted."""
    @F.pandas_udf(COUNTS)
    def of(texts: pd.Series) -> pd.DataFrame:
        auto, rows = automaton(tokens), []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").split() if t else []
            rows.append((len(words), auto.total(words, mark)))
        return pd.DataFrame(rows, columns=COUNTS.names)

    return of(text)
