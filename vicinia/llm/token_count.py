"""Exact token counts by heap-and-linked-list byte-pair merging, without building identifiers.

The symbols of a chunk form a doubly linked list; a heap holds its adjacent pairs that merge to a piece, by rank and then
position. The lowest is popped and merged until none is left. The count is the initial symbols minus the merges, where a
symbol that is no piece counts once for each of its UTF-8 bytes. No piece holds a space after another character or a line
feed, which is checked when the model is read, so merges never cross those places: texts are cut there, and the counts of
chunks that repeat are kept, in a bounded table per worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR = "▁"
#: Chunks whose counts a worker keeps, and the longest of them.
KEPT, KEPT_CHARS = 400_000, 64


class PieceCounter(dict):
    """Counts tokens of texts under a piece model (identity normaliser, leading space, byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(p.vocab_size()) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i)]
        skip = set(special)
        normal = [i for i in range(p.vocab_size()) if i not in skip]
        # Score ties keep one rank: position decides between them.
        levels = {s: r for r, s in enumerate(sorted({p.get_score(i) for i in normal}, reverse=True))}
        self.rank = {p.id_to_piece(i): levels[p.get_score(i)] for i in normal}
        if any(BAR in x.lstrip(BAR) or "\n" in x for x in self.rank):
            raise ValueError("a piece spans a place where texts are cut")
        if not any(p.is_byte(i) for i in special):
            raise ValueError("the model has no byte fallback")
        self.cut = re.compile(f"\n|{BAR}*[^{BAR}\n]+|{BAR}+")

    def merged(self, chunk: str) -> int:
        rank, n = self.rank, len(chunk)
        sym = list(chunk)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(chunk[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if sym[i] else n
            if j >= n or len(sym[i]) + len(sym[j]) != size:
                continue  # one of the two has been merged since
            sym[i] += sym[j]
            sym[j] = ""
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (r := rank.get(sym[i] + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, len(sym[i]) + len(sym[k])))
            h = prev[i]
            if h >= 0 and (r := rank.get(sym[h] + sym[i])) is not None:
                heapq.heappush(heap, (r, h, len(sym[h]) + len(sym[i])))
            merges += 1
        extra = sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in sym if s and s not in rank)
        return n - merges + extra

    def __missing__(self, chunk: str) -> int:
        n = self.merged(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.cut.findall(BAR + text.replace(" ", BAR)))) if text else 0


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One per worker and model, with what it has kept."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; a map over rows, without a shuffle.

    Null and empty texts have no bytes and no tokens. Texts of any length are counted whole. Repeated rows and null ids are
    passed on; other columns are ignored. model_path must be readable by each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
