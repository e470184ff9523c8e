"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie one behind the other in flat numpy arrays, parted further where no piece of the vocabulary goes across. In
each round every sequence merges its lowest-rank pair wherever it has it, from left to right, all sequences at once, until
none has a pair left; what survives is counted. So rounds grow with the different ranks in a sequence, not with its length. Where a
merge brings forth a pair of the same or a lower rank (a vocabulary may rank a longer piece before the piece it contains),
equal pairs cannot go together, and that sequence leaves the arrays to be merged pair by pair from a heap.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prosegrain.llm.common import Batches, bound_batches, rows_of, texts

#: Counts kept by a worker; beyond it the memory is emptied, which changes no result.
CACHE = 600_000
NONE = np.int64(1) << 62


class PieceCounter:
    """Counts of a sentencepiece BPE model with byte fallback; the library itself only gives the vocabulary and normalizes."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        assert not any(map(sp.is_unused, ids)) and any(map(sp.is_byte, range(sp.get_piece_size())))
        self.set_up([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids])
        self.seen: dict[str, int] = {}
        self.line_end = self.unknown("\n") if "\n" not in self.piece else 1

    @classmethod
    def of_pieces(cls, pieces: list[str], scores: list[float]) -> PieceCounter:
        """Without a library: merges only."""
        out = cls.__new__(cls)
        out.set_up(pieces, scores)
        return out

    def set_up(self, pieces: list[str], scores: list[float]) -> None:
        """pieces without control, unknown and byte pieces."""
        self.piece = {p: k for k, p in enumerate(pieces)}
        rank = np.unique(-np.array(scores), return_inverse=True)[1]
        inside = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        #: No piece goes on with the space mark after another character, and none has a line end: the text falls apart there.
        assert not any(x[1] == "▁" and x[0] != "▁" or "\n" in x for x in inside)
        pairs = {}
        for p, k in self.piece.items():
            for i in range(1, len(p)):
                if p[:i] in self.piece and p[i:] in self.piece:
                    pairs[self.piece[p[:i]] << 32 | self.piece[p[i:]]] = (int(rank[k]), k)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        #: For each symbol, whether every pair that it can be part of has a higher rank than the symbol itself; only others are looked at one by one.
        lowest = np.full(len(pieces), np.iinfo(np.int64).max)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            np.minimum.at(lowest, side, self.ranks)
        self.calm = lowest > rank
        #: Neighbouring characters that some piece has; a text falls apart between all others.
        self.joint = np.array(sorted(ord(x[0]) << 32 | ord(x[1]) for x in inside), dtype=np.int64)
        self.alone = np.full(0x110000, -1, dtype=np.int64)
        for p, k in self.piece.items():
            if len(p) == 1:
                self.alone[ord(p)] = k

    @staticmethod
    def unknown(c: str) -> int:
        return len(c.encode())

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the tokens of its line ends."""
        text = self.sp.normalize(text)
        lines = text.split("\n")
        if "▁▁" in text or text.endswith("▁") or "▁\n" in text:
            return [x for y in lines for x in re.findall("▁*[^▁]+|▁+", y)], (len(lines) - 1) * self.line_end
        out = []
        for line in lines:
            first, *rest = line.split("▁")
            if first:
                out.append(first)
            out += ["▁" + x for x in rest]
        return out, (len(lines) - 1) * self.line_end

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index in keys of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), at, -1)

    def wild(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray, here: np.ndarray) -> np.ndarray:
        """For each place to merge, whether the merged symbol makes a pair of no higher rank with what stands beside it then."""
        out = ~self.calm[self.merged[at[here]]]
        k = np.flatnonzero(out)
        if len(k):
            i, end = here[k], len(sym) - 1
            new, rank = self.merged[at[i]], self.ranks[at[i]]
            beside = ((np.where(i > 0, sym[i - 1], -1), new, seq[i - 1] == seq[i]), (new, sym[np.minimum(i + 2, end)], (i + 2 <= end) & (seq[np.minimum(i + 2, end)] == seq[i])), (new, new, np.ones(len(i), bool)))
            out[k] = False
            for left, right, same in beside:
                pair = self.look_up(left, right)
                out[k] |= same & (pair >= 0) & (self.ranks[pair] <= rank)
        return out

    def one_by_one(self, sym: list[int]) -> int:
        """Symbols that survive in one sequence, with a heap of pairs and linked neighbours."""
        n = left = len(sym)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (x := self.pairs.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (x[0], i, sym[i], sym[j], x[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = to, -2, after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return left

    def merge(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word; symbols no piece has count as their bytes."""
        chars = "".join(words)
        code = np.frombuffer(chars.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.alone[code]
        total = np.zeros(len(words), dtype=np.int64)
        if len(odd := np.flatnonzero(sym < 0)):
            np.add.at(total, word[odd], [self.unknown(chars[i]) - 1 for i in odd.tolist()])
        near = code[:-1] << 32 | code[1:]
        where = np.minimum(np.searchsorted(self.joint, near), len(self.joint) - 1)
        apart = (word[:-1] != word[1:]) | (self.joint[where] != near)
        seq = np.concatenate([[0], np.cumsum(apart)]) if len(code) else code
        owner = word[np.flatnonzero(np.diff(seq, prepend=-1))]
        at = np.append(self.look_up(sym[:-1], sym[1:]), -1)
        at[:-1][apart] = -1
        while len(sym):
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            sizes = np.diff(starts, append=len(sym))
            rank = np.where(at >= 0, self.ranks[at], NONE)
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            np.add.at(total, owner[seq[starts[done]]], sizes[done])
            here = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank != NONE))
            # of neighbours, which overlap, every second one from the left
            run = np.flatnonzero(np.diff(here, prepend=-2) != 1)
            place = np.arange(len(here)) - np.repeat(run, np.diff(run, append=len(here)))
            here = here[place % 2 == 0]
            if len(here) and (odd := self.wild(sym, seq, at, here)).any():
                number = np.cumsum(np.diff(seq, prepend=-1) != 0) - 1
                for k in np.unique(number[here[odd]]).tolist():
                    done[k] = True
                    total[owner[seq[starts[k]]]] += self.one_by_one(sym[starts[k] : starts[k] + sizes[k]].tolist())
                here = here[~done[number[here]]]
            sym[here] = self.merged[at[here]]
            keep = np.repeat(~done, sizes)
            keep[here + 1] = False
            now = (np.cumsum(keep) - 1)[here]
            sym, seq, at = sym[keep], seq[keep], at[keep]
            # only the pairs to the left and right of a merge are new
            for i in (now, now[now > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                at[i] = np.where((i < j) & (seq[i] == seq[j]), self.look_up(sym[i], sym[j]), -1)
        return total

    def counts(self, docs: list[str]) -> list[int]:
        split, seen = [self.split(x) if x else ([], 0) for x in docs], self.seen
        new = list({w for words, _ in split for w in words if w not in seen})
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            seen.update(zip(part, self.merge(part).tolist()))
        out = [sum(map(seen.__getitem__, words)) + more for words, more in split]
        if len(seen) > CACHE:
            seen.clear()
        return out


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    """One for each Python worker."""
    return PieceCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """Tokens of every whole text of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    One narrow pass without a shuffle. model_file is a path that every executor has. Null and empty texts have 0
    bytes and 0 tokens; texts and unbroken words of any length are merged whole; repeated rows and null doc_ids give a row
    each; an empty table gives an empty result; other columns of docs are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        count = counter(model_file)
        for batch in batches:
            got = texts(batch)
            n = count.counts(got)
            yield rows_of(batch, ["doc_id"], n_bytes=pa.array([len(x.encode()) for x in got], pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n], pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
