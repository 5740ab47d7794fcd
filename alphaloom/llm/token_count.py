"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN

SPACE = "▁"


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model makes of a text; no identifiers are produced.

    A segment's symbols form a doubly linked list. Adjacent pairs that are pieces wait in a heap by (rank,
    position); the lowest is popped, checked for still being adjacent, and merged into its left end. The count
    is initial symbols minus merges, where a character that is no piece counts as its UTF-8 bytes (byte
    fallback). No piece has the space mark after another character, nor a character of ``hard``, so the text
    is cut before each run of space marks and around those characters, and segments are remembered.
    """

    def __init__(self, model_path: str, remember: int = 400_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spm = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = pb.ModelProto()
        model.ParseFromString(spm.serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("only BPE models with identity normalisation, a leading space mark and byte fallback are counted here")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank) or any(p.type == 4 for p in model.pieces):
            raise ValueError("pieces that span words, or user-defined pieces, are not supported")
        self.newline_is_hard = not any("\n" in p for p in self.rank)
        self.remember = remember
        self.words: dict[str, int] = _Memo(self.word)
        self.segments: dict[str, int] = _Memo(self.merge)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if self.newline_is_hard else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merge(self, segment: str) -> int:
        rank, symbols = self.rank, list(segment)
        initial = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in symbols)
        n = len(symbols)
        heap = [(rank[pair], i, i + 1, 2) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        before, after, merges = list(range(-1, n - 1)), [*range(1, n), -1], 0
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            merges += 1
            symbols[left], symbols[right] = a + b, ""
            after[left] = follow = after[right]
            if follow >= 0:
                before[follow] = left
                if (pair := symbols[left] + symbols[follow]) in rank:
                    heapq.heappush(heap, (rank[pair], left, follow, len(pair)))
            if (lead := before[left]) >= 0 and (pair := symbols[lead] + symbols[left]) in rank:
                heapq.heappush(heap, (rank[pair], lead, left, len(pair)))
        return initial - merges

    def word(self, word: str) -> int:
        """A word after one space, or a line's first word after its newline."""
        if self.newline_is_hard and word[0] == "\n":
            return 1 + (self.merge(word[1:]) if len(word) > 1 else 0)
        return self.merge(SPACE + word)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        spaced = text.replace("\n", " \n") if self.newline_is_hard else text
        if "  " in spaced or SPACE in text or spaced[0] == " " or spaced[-1] == " ":
            return sum(map(self.segments.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))
        return sum(map(self.words.__getitem__, spaced.split(" ")))

    def trim(self) -> None:
        """Bounds the memory of what is remembered; called between batches."""
        for memo in (self.words, self.segments):
            if len(memo) > self.remember:
                memo.clear()


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= 64:  # longer ones hardly come again
            self[key] = found
        return found


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    """One per Python worker and model."""
    return PieceCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` + ``n_bytes``, ``n_tokens``: one row per input row, in one pass without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; keys may be null or repeat and pass through; other columns
    of ``docs`` are ignored; an empty table gives an empty table.
    """
    src = docs.select(*[F.col(k).alias(f"{OWN}k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias(f"{OWN}text"))
    kept = src.drop(f"{OWN}text")

    def run(batches):
        c = counter(model_path)
        for b in batches:
            texts = b.column(f"{OWN}text")
            counts = pa.array([c.count(t.as_py()) for t in texts], pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            c.trim()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, counts], names=[*b.schema.names[:-1], "n_bytes", "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "n_bytes bigint", "n_tokens bigint"])
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"{OWN}k{i}").alias(k) for i, k in enumerate(keys)], "n_bytes", "n_tokens")
