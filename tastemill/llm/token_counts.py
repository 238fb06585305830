"""Exact token counts of byte-level BPE by dynamic programming over prefixes.

Byte-pair encoding has this property: a sequence of tokens is the encoding of its bytes exactly if
each token encodes to itself and each pair of neighbours is the encoding of the pair's bytes. So the last
token of the encoding of a prefix follows from shorter prefixes: of the tokens that end the prefix, it
is the one that fits the last token before it, and count[prefix] = count[rest] + 1. One pass over a
piece gives the exact count at every prefix.

A text falls into chunks (white space and what follows it up to the next white space) that no token
crosses; chunks repeat, so a bounded cache keeps their counts. `PrefixTable` holds the running counts at
the chunk ends of one text; the count at any other prefix is that of the chunks before it and of the
cut chunk. It answers "how many tokens has this prefix" and "which is the longest prefix of at most n
tokens" without encoding the text again.

Special strings of the tokenizer file inside a text count as one token each, as its library does by
default. Defined cases: a null text is the empty text and has no tokens; an empty table gives an empty
result; repeated rows and null ids are counted row by row. Memory: one batch of texts and the caches."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm._common import Cache, ensure_importable, holds

#: Characters with the Unicode property White_Space. Fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
#: How byte-level BPE cuts text into pieces before merging.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NO_RANK = 1 << 60
CACHE_CHUNKS = 500_000
CACHE_PAIRS = 1_000_000
CACHE_BYTES = 64  # longer chunks and pieces are computed anew


class Counter:
    """Tokens of chunks, by pieces' prefix counts from the dynamic programme. The caches are bounded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        as_byte = {c: b for b, c in byte_letters().items()}
        special = set(self.special)
        raw = lambda token: bytes(as_byte[c] for c in token)
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.longest = max(map(len, self.tokens))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.chunk_re = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.piece_re = regex.compile(PIECE)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.known, self.chunks = Cache(self.piece, CACHE_CHUNKS, CACHE_BYTES), Cache(self.pieces, CACHE_CHUNKS, CACHE_BYTES)

    def merged(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The encoding of a few bytes, always merging the first of the best-ranked pairs; the last pair merged."""
        parts, rank, last = [data[i : i + 1] for i in range(len(data))], self.rank, None
        while len(parts) > 1:
            ranks = [rank.get(p, NO_RANK) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == NO_RANK:
                break
            at = ranks.index(best)
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def stands(self, token: bytes) -> bool:
        """Does the token encode to itself? Then `made` has the pair it is made of last, and that pair's rank."""
        known = self.alone.get(token)
        if known is None:
            parts, pair = self.merged(token) if token in self.tokens else ([], None)
            known = self.alone[token] = parts == [token]
            if known:
                self.made[token] = (self.rank[pair], *pair) if pair else (-1, b"", b"")
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Is the encoding of a + b these two tokens? Both stand alone.

        Their merges are undone from the last one back. In each state the pair at the border must not have
        been the better choice than the merge that was undone; of equal ranks the left one goes first."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        left, right, limit, rank = a, b, NO_RANK, self.rank
        while True:
            if rank.get((left, right), NO_RANK) < limit:
                known = False
                break
            of_left, of_right = self.made_of(left), self.made_of(right)
            if of_left[0] < 0 and of_right[0] < 0:
                known = True
                break
            if of_left[0] > of_right[0]:
                limit, left = of_left[0], of_left[2]
            else:
                limit, right = of_right[0] + 1, of_right[1]
        self.pairs[a, b] = known
        return known

    def made_of(self, token: bytes) -> tuple[int, bytes, bytes]:
        if (known := self.made.get(token)) is None:
            self.stands(token)  # what a token is made of stands alone as well
            known = self.made[token]
        return known

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for every i."""
        n, alone, pairs, longest = len(piece), self.alone, self.pairs, self.longest
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = piece[j:i]
                ok = alone.get(t)
                if ok is None:
                    ok = self.stands(t) if t in self.tokens else False
                if ok:
                    if j:
                        ok = pairs.get((last[j], t))
                        if ok is None:
                            ok = self.fits(last[j], t)
                    if ok:
                        counts[i], last[i] = counts[j] + 1, t
                        break
        return counts

    def piece(self, x: str) -> int:
        data = x.encode()
        return 1 if data in self.tokens and self.stands(data) else self.prefix_counts(data)[-1]

    def pieces(self, chunk: str) -> int:
        return sum(map(self.known.__getitem__, self.piece_re.findall(chunk)))

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings; whether a part is one."""
        at = 0
        for m in self.special_re.finditer(text) if self.special_re else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def running(self, text: str) -> tuple[list[str], list[int]]:
        """The text's chunks, and the tokens of the prefix that ends with each."""
        if any(s in text for s in self.special):
            table = PrefixTable(self, text)
            return [text[a:b] for a, b in zip(table.ends, table.ends[1:])], table.totals[1:]
        chunks = self.chunk_re.findall(text)
        return chunks, list(accumulate(map(self.chunks.__getitem__, chunks)))

    def within(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and the characters of its longest prefix of whole chunks that has at most `limit`."""
        chunks, totals = self.running(text)
        if not totals or totals[-1] <= limit:
            return totals[-1] if totals else 0, len(text)
        return totals[-1], sum(map(len, chunks[: bisect_right(totals, limit)]))

    def count(self, text: str) -> int:
        if not any(s in text for s in self.special):
            return sum(map(self.chunks.__getitem__, self.chunk_re.findall(text)))
        return sum(1 if special else sum(map(self.chunks.__getitem__, self.chunk_re.findall(part))) for part, special in self.segments(text))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level files write each byte: itself if printable, else the next letter from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PrefixTable:
    """Token counts at all prefixes of one text: ends (in characters) and running counts of its chunks."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text, self.ends, self.totals, self.special = counter, text, [0], [0], [False]
        for part, special in counter.segments(text):
            for chunk in [part] if special else counter.chunk_re.findall(part):
                self.ends.append(self.ends[-1] + len(chunk))
                self.totals.append(self.totals[-1] + (1 if special else counter.chunks[chunk]))
                self.special.append(special)

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]. A special string that is cut is ordinary text, together with what precedes it."""
        chars = min(chars, len(self.text))
        k = bisect_right(self.ends, chars) - 1
        if self.ends[k] == chars:
            return self.totals[k]
        start = k
        while start and self.special[k + 1] and not self.special[start] and start > k - 1:
            start -= 1
        return self.totals[start] + self.counter.count(self.text[self.ends[start] : chars])

    def longest(self, tokens: int) -> int:
        """The most characters such that this prefix and all chunk-end prefixes before it have at most so many tokens."""
        k = bisect_right(self.totals, tokens) - 1
        at = self.ends[k]
        if k + 1 < len(self.ends):
            fit = [c for c in range(self.ends[k] + 1, self.ends[k + 1]) if self.count(c) <= tokens]
            at = max(fit, default=at)
        return at


@lru_cache(2)
def counter_of(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of df: the id, n_bytes, n_tokens, over_limit, and fit_chars: the length of the longest prefix
    of whole chunks with at most `limit` tokens, read off the text's running counts.

    tokenizer: path of a byte-level BPE file, readable by every executor."""
    ensure_importable(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("counts", counter_of.cache_clear)
        within = counter_of(tokenizer).within
        for b in batches:
            found = [within(x.as_py(), limit) for x in b.column("text")]
            tokens, fit = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), tokens, fit], ["id", "n_bytes", "n_tokens", "fit_chars"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, fit_chars long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
