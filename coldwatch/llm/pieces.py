"""Encoding to and decoding from the pieces of a merge-type sentencepiece vocabulary.

A text becomes a row of single characters. An agenda holds the adjacent pairs that together
are a piece, best score first, at equal scores the leftmost; the best pair merges, the pairs it
was part of lapse, and those of the merged piece with its neighbours join the agenda, until it
is empty. What is no piece then falls back to its bytes.

No piece of such a vocabulary goes on across the start of a space, or from a letter to closing punctuation, so
the stretches between are independent: each distinct one is merged once per worker, checked against the
sentencepiece library in the same Arrow batch, and remembered (a bounded memo). Whether the
vocabulary keeps to these borders is read from its pieces, not assumed. The agendas of all new stretches of a batch are
stepped together: a row of symbols each, where the row's best pair, the leftmost of equals, merges at every step.

``encode`` adds ids, ``decode`` turns them back with the library's decode(ids). NULL and empty texts have the end id alone and
decode to the empty text. Repeated rows are kept.
"""
from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.tables import Memo, documents, free_name, lean

CHUNKS, STRETCHES = 300_000, 600_000
ROWS = 500
WIDTHS = (8, 16, 32, 64)  # stretches of more characters have an agenda of their own
NONE = np.iinfo(np.int64).max
SPACE = "▁"  # fixed value: how pieces show a space
MARKS = ".,;:!?\n"
NORMAL = 1  # fixed value: the type number of ordinary pieces


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers: what a memo holds."""
    return np.array(ids, "<i4").tobytes()


class PieceEncoder:
    def __init__(self, vocabulary: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(vocabulary, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if rules.name != "identity" or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("a vocabulary that keeps texts as they are is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.end_id = self.library.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(model.pieces)}
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        self.unchecked, self.pending = [], set()
        self.bytes = [self.ids[f"<0x{b:02X}>"] for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("pieces that go on across the start of a space are not supported")
        marks = "".join(m for m in MARKS if not any(re.search("[A-Za-z]" + re.escape(m), p) for p in scores))
        self.border = re.compile(f"(?<=[A-Za-z])(?=[{re.escape(marks)}])" if marks else "$^")
        self.chunks = Memo(self._chunk, CHUNKS)
        self.stretches = Memo(self._stretch, STRETCHES)
        # symbols as numbers: pieces by id, other characters by code point behind the ids
        self.size = len(model.pieces)
        self.symbols = self.size + np.arange(0x110000)
        for piece in self.ranks:
            if len(piece) == 1:
                self.symbols[ord(piece)] = self.ids[piece]
        pairs = sorted(
            (left * (self.size + 0x110000) + right, rank, self.ids[piece])
            for piece, rank in self.ranks.items() for k in range(1, len(piece))
            if (left := self._symbol(piece[:k])) is not None and (right := self._symbol(piece[k:])) is not None)
        self.keys, self.pair_ranks, self.joined = (np.array(c, np.int64) for c in (zip(*pairs) if pairs else ([NONE], [NONE], [-1])))

    def _symbol(self, text: str) -> int | None:
        return self.ids[text] if text in self.ranks else self.size + ord(text) if len(text) == 1 else None

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE`` if it is no piece) and the symbol it becomes."""
        wanted = left * (self.size + 0x110000) + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], NONE), self.joined[at]

    def merged_together(self, texts: list[str], width: int) -> list[bytes]:
        """The ids of each of ``texts``, of ``width`` characters at most, when all agendas have run empty."""
        out = [b""] * len(texts)
        sizes = np.array([*map(len, texts)])
        symbols = np.full((len(texts), width + 2), -1)
        symbols[np.arange(width + 2) < sizes[:, None]] = self.symbols[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        ranks, joined = self._pairs(symbols[:, :-1], symbols[:, 1:])
        rows, places = np.arange(len(texts)), np.arange(width + 2)
        while len(rows):
            at = ranks.argmin(1)
            live = ranks[np.arange(len(rows)), at] < NONE
            if not live.all():
                done = symbols[~live]
                whole, step = done.astype("<i4").tobytes(), 4 * (width + 2)
                ends, known = 4 * (done < 0).argmax(1), done.max(1) < self.size
                for k, (row, end, ids) in enumerate(zip(rows[~live].tolist(), ends.tolist(), known.tolist())):
                    own = whole[k * step:k * step + end]
                    out[row] = own if ids else self._spelt(np.frombuffer(own, "<i4").tolist())
                rows, at, symbols, ranks, joined = rows[live], at[live], symbols[live], ranks[live], joined[live]
            each = np.arange(len(rows))
            symbols[each, at] = joined[each, at]
            moved = np.minimum(places + (places > at[:, None]), width + 1)  # the right symbol of the pair goes
            symbols = np.take_along_axis(symbols, moved, 1)
            ranks, joined = (np.take_along_axis(m, np.minimum(moved[:, :-1], width), 1) for m in (ranks, joined))
            for left in (at, at - 1):
                inside = left >= 0
                row, left = each[inside], left[inside]
                ranks[row, left], joined[row, left] = self._pairs(symbols[row, left], symbols[row, left + 1])
        return out

    def _spelt(self, symbols: list[int]) -> bytes:
        """Ids where characters that are no pieces fall back to their bytes."""
        ids = chain.from_iterable([s] if s < self.size else (self.bytes[b] for b in chr(s - self.size).encode()) for s in symbols)
        return packed([*ids])

    def learn(self, stretches: set[str]) -> None:
        """Merges and remembers what is new among ``stretches``."""
        new = [s for s in stretches if s not in self.stretches]
        self.stretches.room(len(new))
        low = 0
        for width in WIDTHS:
            own = [s for s in new if low < len(s) <= width]
            low = width
            if not own:
                continue
            self.stretches.update(zip(own, self.merged_together(own, width)))
            self.pending.update(own)

    def merged(self, text: str) -> list[str]:
        """The symbols of ``text`` when its agenda has run empty.

        An entry of the agenda is one number, a pair's rank and the place of its left symbol.
        """
        symbols, rank = list(text), self.ranks.get
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = []
        for left in range(size - 1):
            r = rank(symbols[left] + symbols[left + 1])
            if r is not None:
                agenda.append(r << 32 | left)
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right >= size or not symbols[left]:
                continue
            pair = symbols[left] + symbols[right]
            if rank(pair) != entry >> 32:
                continue  # lapsed: one of the two has merged since
            symbols[left], symbols[right] = pair, ""
            right = after[left] = after[right]
            if right < size:
                before[right] = left
                r = rank(pair + symbols[right])
                if r is not None:
                    heapq.heappush(agenda, r << 32 | left)
            left = before[left]
            if left >= 0:
                r = rank(symbols[left] + pair)
                if r is not None:
                    heapq.heappush(agenda, r << 32 | left)
        return [s for s in symbols if s]

    def _stretch(self, text: str) -> bytes:
        self.pending.add(text)
        symbols = (self._symbol(symbol) for symbol in self.merged(text))
        return self._spelt([*symbols])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two spaces, noted for the check if a stretch in it is new."""
        parts = self.border.split(SPACE + chunk)
        ids = b"".join(map(self.stretches.__getitem__, parts))
        if not self.pending.isdisjoint(parts):
            self.unchecked.append((chunk, ids))
        return ids

    def check(self) -> None:
        """Compares what is new since the last check with the library."""
        if self.unchecked:
            chunks, ids = zip(*self.unchecked)
            self.unchecked.clear()
            self.pending.clear()
            theirs = self.library.encode(list(chunks), num_threads=1)
            if [len(i) // 4 for i in ids] != [*map(len, theirs)] or b"".join(ids) != packed([*chain.from_iterable(theirs)]):
                chunk = next(c for c, own, other in zip(chunks, ids, theirs) if own != packed(other))
                raise ValueError(f"the library encodes {chunk!r} in another way")

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without the end id."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text without the end id; what is new in them is merged together and compared with the library."""
        rows, chunks, stretches = [], set(), set()
        for text in texts:
            if not text:
                rows.append(None)
            elif "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
                rows.append(self._spaced(text))
                stretches.update(rows[-1])
            else:
                rows.append(text.split(" "))
                chunks.update(rows[-1])
        new = {c: [SPACE + c] if c.isalpha() else self.border.split(SPACE + c) for c in chunks if c not in self.chunks}
        stretches.update(chain.from_iterable(new.values()))
        self.learn(stretches)
        self.chunks.room(len(new))
        for chunk, parts in new.items():
            ids = self.chunks[chunk] = self.stretches[parts[0]] if len(parts) == 1 else b"".join(map(self.stretches.__getitem__, parts))
            if not self.pending.isdisjoint(parts):
                self.unchecked.append((chunk, ids))
        out = []
        for text, parts in zip(texts, rows):
            if parts is None:
                ids = b""
            elif isinstance(parts, tuple):
                ids = b"".join(map(self.stretches.__getitem__, parts))
                if not self.pending.isdisjoint(parts):
                    self.unchecked.append((text, ids))
            else:
                ids = b"".join(map(self.chunks.__getitem__, parts))
            out.append(np.frombuffer(ids, "<i4").tolist())
        self.check()
        return out

    def _spaced(self, text: str) -> tuple[str, ...]:
        """The stretches of a text with spaces in a row: a run of spaces and what follows."""
        shown = SPACE + text.replace(" ", SPACE)
        return tuple(s for p in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", shown) for s in self.border.split(p))


@cache
def encoder(vocabulary: str) -> PieceEncoder:
    return PieceEncoder(vocabulary)


def sliced(texts: pa.Array) -> Iterator[list[str | None]]:
    """Few texts at a time as Python strings."""
    for at in range(0, len(texts), ROWS):
        yield texts.slice(at, ROWS).to_pylist()


def encode(docs: DataFrame, vocabulary: str, name: str = "ids") -> DataFrame:
    """All columns and ``name``: the text's ids and the end id."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        words = encoder(vocabulary)
        parts = [pa.array([[*ids, words.end_id] for ids in words.encode_all(part)], pa.list_(pa.int32())) for part in sliced(texts)]
        return pa.concat_arrays(parts or [pa.array([], pa.list_(pa.int32()))])

    return docs.withColumn(name, ids("text"))


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and ``name``: the text of ``ids``; NULL ids give the empty text."""
    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        library = encoder(vocabulary).library
        return pa.array([library.decode(i or []) for i in column.to_pylist()], pa.string())

    return rows.withColumn(name, texts(ids))


def encoded_and_decoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All columns but text, with ids and decoded; ids stay in one task between the two."""
    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = encoder(vocabulary)

        def both(texts: pa.Array) -> pa.Array:
            columns = [[pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.string())]]
            for part in sliced(texts):
                ids = [[*own, words.end_id] for own in words.encode_all(part)]
                columns[0].append(pa.array(ids, pa.list_(pa.int32())))
                columns[1].append(pa.array([*map(words.library.decode, ids)], pa.string()))
            return pa.StructArray.from_arrays([*map(pa.concat_arrays, columns)], ["ids", "decoded"])

        yield from lean(map(both, batches))

    others, pair = [c for c in docs.columns if c != "text"], free_name(docs, "pair")
    return docs.withColumn(pair, round_trip("text")).select(*(F.col(f"`{c}`") for c in others), f"{pair}.*")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text they decode to.

    Encodes and decodes like ``encode`` and ``decode`` without sending ids between the two.
    """
    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, rows = whole.slice(at, ROWS), []
                for own in words.encode_all(batch.column("text").to_pylist()):
                    ids = [*own, words.end_id]
                    decoded = words.library.decode(ids)
                    rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                 hashlib.sha256(decoded.encode()).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(column) for column in zip(*rows))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: lean(round_trip(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
