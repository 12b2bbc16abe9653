"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie of word-initial and continuation pieces. Every node has a failure link to the node of what is
left after popping the longest pieces from its string, and the number of pieces popped on the way (Song et al. 2021).
A word is read once, byte by byte; on a missing edge the automaton adds the popped count and follows the link, so no
piece is built and no byte is read twice. Where the bare space is a piece, it starts a word that no longer piece starts.
A word that cannot be cut into pieces is one unknown token.

The automaton (bounded by the vocabulary file) is built on the driver and sent to the tasks; documents are counted in
one Arrow pass without a shuffle, each distinct word of a batch once.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = -1


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuation pieces of a file with a base64 piece and a rank a line; a leading space marks initial ones. The bare space is the empty initial piece."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p[1:] for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class Automaton:
    """edges: node << 8 | byte -> node; fail and pops by node. Node 0 starts a word, node 1 continues one."""

    def __init__(self, initial: list[bytes], following: list[bytes]):
        self.edges: dict[int, int] = {}
        self.fail, self.pops = [NONE, NONE], [0, 0]
        whole = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                u = root
                for c in piece:
                    v = self.edges.get(u << 8 | c)
                    if v is None:
                        v = self.edges[u << 8 | c] = len(self.fail)
                        self.fail.append(NONE)
                        self.pops.append(0)
                        whole.append(False)
                    u = v
                if piece:
                    whole[u] = True
        if b"" in initial:
            self.fail[0], self.pops[0] = 1, 1
        below: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.edges.items():
            below.setdefault(key >> 8, []).append((key & 255, v))
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in below.get(u, ()):
                queue.append(v)
                if whole[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while z != NONE and z << 8 | c not in self.edges:
                    n += self.pops[z]
                    z = self.fail[z]
                if z != NONE:
                    self.fail[v], self.pops[v] = self.edges[z << 8 | c], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it has none."""
        edges, fail, pops = self.edges, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := edges.get(u << 8 | c)) is None:
                n += pops[u]
                u = fail[u]
                if u == NONE:
                    return 0
            u = v
        while u != 1:
            n += pops[u]
            u = fail[u]
            if u == NONE:
                return 0
        return n


def _count(model):
    def run(batches):
        import pyarrow as pa

        count = model.value.count
        for batch in slices(batches):
            known: dict[bytes, int] = {}
            words, tokens, unknown = [], [], []
            for text in batch.column("text").to_pylist():
                split = (text or "").encode().split()
                sizes = []
                for w in split:
                    n = known.get(w)
                    if n is None:
                        n = known[w] = count(w)
                    sizes.append(n)
                missing = sizes.count(0)
                words.append(len(split))
                tokens.append(sum(sizes) + missing)
                unknown.append(missing)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.array(x, np.int64)) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])
    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown), a row for each of docs (doc_id, text).

    Words are runs of anything but ASCII white space. A null or empty text has no tokens; null ids and rows that repeat
    stay rows; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(Automaton(*read_vocabulary(vocabulary)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(model), "doc_id long, n_words long, n_tokens long, n_unknown long")
