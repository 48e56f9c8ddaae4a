"""Exact token counts of every prefix, by dynamic programming instead of encoding again.

In byte-pair encoding the tokens of a byte string are the only chain of tokens in which every two
neighbours are *stable*: no merge over their border would come before the merges that built them.
So the last token of a prefix is the one vocabulary token that ends there and is stable next to
the last token of the prefix before it, and

    count[end] = count[end - length of the last token] + 1

gives the count at every prefix in one pass. Words of the pre-tokenizer are independent, so a
text's counts are those of its words, added up; the counts of a distinct word are computed once
per worker and remembered (a bounded memo). From them ``count_tokens`` answers how many tokens a text has and how
much of it fits a budget, and ``with_prefix_counts`` keeps all of a text's counts.

NULL and empty texts have no tokens. Repeated rows are kept, columns beside doc_id and text
ignored by ``count_tokens`` and kept by ``with_prefix_counts``.
"""
from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.tables import Memo, documents

CHUNKS, WORDS, BORDERS = 200_000, 500_000, 400_000

# The word pattern of this vocabulary, and letters and digits newer than its library.
NEWER = "\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[%s]]+| ?[\p{N}--[%s]]+"
                r"| ?[[^\s\p{L}\p{N}]||[%s]]+|\s+(?!\S)|\s+") % (NEWER, NEWER, NEWER)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        with open(vocabulary, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        plain = {token: bytes(letters[c] for c in token) for token in content["model"]["vocab"]
                 if all(c in letters for c in token)}
        self.specials = sorted((t["content"] for t in content["added_tokens"]), key=len, reverse=True)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[int, bytes, bytes]] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = (plain[t] for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[left, right] = rank
            self.parts.setdefault(left + right, (rank, left, right))
        self.edges = ({}, {})
        self.borders = Memo(self._stable, BORDERS)
        self.tokens = {bytes([b]) for b in range(256)}
        for token, (rank, left, right) in self.parts.items():
            if left in self.tokens and right in self.tokens and self._stable((left, right), rank):
                self.tokens.add(token)
        self.ending = ahocorasick.Automaton()
        for token in self.tokens:
            self.ending.add_word(token.decode("latin-1"), token)
        self.ending.make_automaton()
        self.words = Memo(self._word, WORDS)
        self.spaced = Memo(self._spaced, CHUNKS)
        self.space = regex.compile(r"\s+")
        self.tail = regex.compile(r"\s*\S*\s*$")
        self.pattern = regex.compile(WORD_PATTERN, regex.V1)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The pieces at one edge of a token as it is built, each with the rank of the merge that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, piece, ends = [], token, float("inf")
            while True:
                known.append((piece, ends))
                if piece not in self.parts:
                    break
                ends, *halves = self.parts[piece]
                piece = halves[side]
            self.edges[side][token] = known
        return known

    def _stable(self, border: tuple[bytes, bytes], before: float = float("inf")) -> bool:
        """No merge across the border comes before those that end the pieces beside it.

        At equal rank the merge further left comes first.
        """
        left, right = border
        ranks, beside = self.rank, self._edge(right, 0)
        for x, x_ends in self._edge(left, 1):
            for y, y_ends in beside:
                rank = ranks.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends and rank < before:
                    return False
        return True

    def _word(self, word: str) -> tuple[int, ...]:
        return self.counts(word.encode())

    def counts(self, word: bytes) -> tuple[int, ...]:
        """Tokens of each prefix of a word, by its bytes; the first entry is for no byte."""
        counts, last, borders = [0] * (len(word) + 1), [b""] * (len(word) + 1), self.borders
        for end, token in self.ending.iter(word.decode("latin-1")):  # all tokens, by where they end
            start = end + 1 - len(token)
            if not counts[end + 1] and (not start or borders[last[start], token]):
                counts[end + 1], last[end + 1] = counts[start] + 1, token
        return tuple(counts)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of a text, and whether each is a special token."""
        at = 0
        if self.special_pattern and any(s in text for s in self.specials):
            for match in self.special_pattern.finditer(text):
                yield text[at:match.start()], False
                yield match[0], True
                at = match.end()
        yield text[at:], False

    def _spaced(self, chunk: str) -> int | None:
        """Tokens of a space and ``chunk``; None if white space meets white space there."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return self._total(" " + chunk)

    def _total(self, text: str) -> int:
        words = self.words
        return sum(1 if special else sum(words[w][-1] for w in self.pattern.findall(part))
                   for part, special in self.segments(text))

    def total(self, text: str) -> int:
        """Tokens of a text: no word goes on across the start of white space, so texts whose
        spaces stand alone are counted by what lies between them."""
        chunks = text.split(" ")
        counts = [*map(self.spaced.__getitem__, chunks[1:])]
        if None in counts or chunks[0][-1:].isspace():
            return self._total(text)
        return self._total(chunks[0]) + sum(counts)

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:i]`` for every i from 0 to its length.

        A prefix that ends within a word ends with a shorter word, except that white space before a
        word, and a contraction, are read anew; a special token cut short is ordinary text.
        """
        out, base, behind = [0], 0, ""
        for part, special in self.segments(text):
            if special:
                tail = self.tail.search(behind)[0]
                before = base - self._total(tail)
                out += [before + self._total(tail + part[:i]) for i in range(1, len(part))] + [base + 1]
                base, behind = base + 1, ""
                continue
            run = ""
            for word in self.pattern.findall(part):
                if run and self.space.match(word):
                    # behind other white space: the run so far is one word until the text goes on
                    out.append(base - self._total(run) + self._total(run + word[0]))
                    out += [base + self._total(word[:i]) for i in range(2, len(word) + 1)]
                elif word[0] == "'" and len(word) > 1:
                    out += [base + self._total(word[:i]) for i in range(1, len(word) + 1)]
                else:
                    by_byte, size = self.words[word], 0
                    for letter in word:
                        size += len(letter.encode())
                        out.append(base + by_byte[size])
                base += self.words[word][-1]
                run = word if self.space.fullmatch(word) else ""
            behind = part
        return out

    def fits(self, text: str, limit: int) -> int:
        """Code points of the longest stretch of whole words from the start with at most ``limit``
        tokens, and of the next word what still fits."""
        chars = tokens = 0
        for part, special in self.segments(text):
            if special:
                if tokens + 1 > limit:
                    return chars
                chars, tokens = chars + len(part), tokens + 1
                continue
            found = self.pattern.findall(part)
            sums = list(accumulate(self.words[w][-1] for w in found))
            whole = bisect_right(sums, limit - tokens)
            chars += sum(map(len, found[:whole]))
            if whole < len(found):
                left = limit - tokens - (sums[whole - 1] if whole else 0)
                by_byte, size = self.words[found[whole]], 0
                sizes = [size := size + len(letter.encode()) for letter in found[whole]]
                return chars + max((i for i, s in enumerate(sizes, 1) if by_byte[s] <= left), default=0)
            tokens += sums[-1] if sums else 0
        return chars


@cache
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: code points within the limit."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(vocabulary)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            tokens = [words.total(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens]),
                pa.array([words.fits(t, limit) if n > limit else len(t) for t, n in zip(texts, tokens)], pa.int64()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def with_prefix_counts(docs: DataFrame, vocabulary: str, name: str = "prefix_tokens") -> DataFrame:
    """All columns and ``name``: for each i from 0 to the text's length, the tokens of its first i code points."""
    @F.arrow_udf("array<int>")
    def prefixes(texts: pa.Array) -> pa.Array:
        words = counter(vocabulary)
        return pa.array([words.prefix_counts(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(name, prefixes("text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024)
