"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its number of initial byte symbols minus the merges made; no token
identifiers are built. The library's own pre-tokenizer cuts the pieces, so the pieces agree with it
to the character; the merging is done here. A piece between two single spaces can't be joined with
its neighbours by the pre-tokenizer, so counts are remembered by such pieces, in a bounded memory.

Null or empty text: 0 bytes, 0 tokens. Every row gives a row (repeated rows repeat). Columns of the
input other than the id are left out, so they cannot clash.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import field, map_texts, read

#: A sum that holds this is of a text in which a piece touches more white space than its one space.
UNSAFE = -(1 << 50)
#: A Latin word, perhaps after a space: one piece for the pre-tokenizer; a full stop or comma behind it is another, of one token.
WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
#: The symbol that stands for each byte: the printable ones for themselves, the others from 256 on.
SYMBOL = [chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256)]


def count_merged(symbols: str, ranks: dict) -> int:
    """Symbols left after all merges: pop the lowest-ranked adjacent pair (leftmost first), relink, push the new neighbours."""
    sym, n = list(symbols), len(symbols)
    if n < 2:
        return n
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapify(heap)
    left = n
    while heap:
        rank, i = heappop(heap)
        j = nxt[i]
        if sym[i] is None or j >= n or ranks.get((sym[i], sym[j])) != rank:
            continue  # one of the two has been merged since
        sym[i] += sym[j]
        sym[j] = None
        left -= 1
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heappush(heap, (r, i))
        if (h := prv[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heappush(heap, (r, h))
    return left


class PieceCounts(dict):
    """Tokens of `prefix + piece`. Short pieces are remembered in two generations of `limit` at most:
    when the younger is full it becomes the older, and what is used again is taken over."""

    def __init__(self, count, prefix: str, limit: int):
        super().__init__()
        self.count, self.prefix, self.limit, self.old = count, prefix, limit, {}

    def __missing__(self, piece: str) -> int:
        if (n := self.old.get(piece)) is None:
            if self.prefix and (not piece or piece[0].isspace()) or piece and piece[-1].isspace():
                n = UNSAFE
            else:
                n = self.count(self.prefix + piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens as the tokenizers library does with a byte-level BPE file."""

    def __init__(self, path: str | None = None, limit: int = 500_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.words = PieceCounts(lambda w: count_merged(w, self.ranks), "", limit)
        self.first, self.rest = PieceCounts(self.whole, "", limit), PieceCounts(self.whole, " ", limit)

    def whole(self, text: str) -> int:
        """Any text: strings of special tokens count one each, what lies between is cut and merged."""
        if m := WORD.fullmatch(text):
            return self.words["".join(map(SYMBOL.__getitem__, m[1].encode()))] + bool(m[2])
        for s in self.special:
            if s in text:
                parts = text.split(s)
                return sum(map(self.whole, parts)) + len(parts) - 1
        return sum(self.words[p] for p, _ in self.pieces(text)) if text else 0

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.split(" ")
        n = self.first[parts[0]] + sum(map(self.rest.__getitem__, parts[1:]))
        return n if n >= 0 else self.whole(text)


COUNTERS: dict = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row. tokenizer_path: on the executors; None takes the installed byte_bpe_50k.json."""

    def make():
        counter = COUNTERS.get(tokenizer_path) or COUNTERS.setdefault(tokenizer_path, TokenCounter(tokenizer_path))
        return lambda texts: [[len(t.encode()) if t else 0 for t in texts], [counter(t) for t in texts]]

    out = map_texts(docs, text_col, [id_col], [field("n_bytes", "long"), field("n_tokens", "long")], make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
